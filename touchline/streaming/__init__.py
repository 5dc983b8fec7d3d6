"""touchline.streaming"""
