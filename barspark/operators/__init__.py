"""barspark.operators"""
