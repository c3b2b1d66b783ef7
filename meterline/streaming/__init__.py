"""meterline.streaming"""
