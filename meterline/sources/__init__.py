"""meterline.sources"""
