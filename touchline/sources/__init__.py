"""touchline.sources"""
