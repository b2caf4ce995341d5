"""Fleet-scale analytics for environmental-sensor time series on PySpark."""
