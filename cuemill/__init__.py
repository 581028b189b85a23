"""cuemill: build, label and evaluate cue-labelled sentence corpora with Spark DataFrames."""
