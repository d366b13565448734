"""Print-document analytics and corpus preparation on Spark."""
