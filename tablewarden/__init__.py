"""tablewarden: table snapshots, restores, checks and run-log judgement on Spark DataFrames."""

__version__ = "0.1.0"
