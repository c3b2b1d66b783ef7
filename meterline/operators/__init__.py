"""meterline.operators"""
