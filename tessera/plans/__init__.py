"""Chained plans: the ``run()`` driver loop and the registered query catalogue."""
