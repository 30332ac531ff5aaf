"""Analytics over streams of observed text and audio, written as Spark DataFrame jobs."""
