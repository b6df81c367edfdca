"""Analyze / prepare / solve: Krylov methods, preconditioners and controllers over matrices as tables."""
