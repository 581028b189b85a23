"""Column functions shared by the batch and streaming jobs."""
