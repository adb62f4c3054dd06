"""foldlake: last-writer-wins folds over versioned key-value change logs, on Spark DataFrames."""
