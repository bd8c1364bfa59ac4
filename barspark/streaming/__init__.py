"""barspark.streaming"""
