"""touchline.operators"""
