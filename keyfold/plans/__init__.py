"""keyfold.plans"""
