"""Text evidence on Spark: DataFrame operators that turn documents and transcripts into reviewable evidence."""

__version__ = "0.1.0"
