"""Row-local operators that also accept a streaming DataFrame.

They are plain column expressions (a frozen repair plan, masking, law checks and
projections), so ``readStream`` tables pass through them unchanged; anything
that aggregates a whole table is a batch job.
"""

from ..operators.clean import apply_plan
from ..operators.laws import project, violating_rows
from ..operators.privacy import mask

__all__ = ["apply_plan", "mask", "project", "violating_rows"]
