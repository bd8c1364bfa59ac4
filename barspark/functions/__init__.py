"""barspark.functions"""
