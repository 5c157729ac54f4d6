"""keyfold.operators"""
