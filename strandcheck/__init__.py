"""strandcheck: sequencing-file checks as Spark DataFrames.

Every metric is a function from DataFrames to a DataFrame, so one definition
serves decoded BAM/FASTQ bytes, Parquet copies of them and any table with the
same columns.
"""

__version__ = "0.1.0"
