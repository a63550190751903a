"""Continuous imports: the batch revisions of operators.revise applied to each micro-batch."""
