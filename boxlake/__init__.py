"""boxlake: sports-performance analytics and corpus preparation as Spark DataFrame jobs."""
