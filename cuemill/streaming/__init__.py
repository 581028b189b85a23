"""The feed jobs as streams."""
