"""meterline.functions"""
