"""barspark.sources"""
