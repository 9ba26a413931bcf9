"""Table-level data intelligence jobs expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
