"""meterline.plans"""
