"""keyfold.streaming"""
