"""touchline.functions"""
