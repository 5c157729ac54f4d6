"""keyfold.sources"""
