"""Image-plane and block analytics as Spark DataFrame jobs."""
