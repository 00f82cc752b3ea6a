"""Equal-width histogram binning with numpy's edge rule.

Bins are right-open except the last, which is closed: the maximum lands in
bin ``n-1``. (``width_bucket`` would send it to ``n+1``.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal_width_bin(x: Column, lo: Column, hi: Column, n_bins: int) -> Column:
    w = (hi - lo) / F.lit(float(n_bins))
    b = F.floor((x - lo) / w).cast("int")
    return F.when(hi == lo, F.lit(0)).otherwise(F.least(F.greatest(b, F.lit(0)), F.lit(n_bins - 1)))
