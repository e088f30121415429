"""Column functions: vectors and rotations, four-valued statuses, numbers and intervals."""
