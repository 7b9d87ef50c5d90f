"""tributary: recommendation-funnel analytics and training-data operators as Spark DataFrame plans."""
