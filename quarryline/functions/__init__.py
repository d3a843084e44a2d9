"""Column functions, the calculator, and checkpoints."""
