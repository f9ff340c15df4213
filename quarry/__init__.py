"""quarry: tabular exploration, modelling and scoring as Spark DataFrame jobs.

Every data pass runs on executors as DataFrame/SQL work; the driver only sees
small sufficient statistics (per-column moments, p x p co-moment matrices,
bucket counts, per-class counts, metric rows).
"""

from quarry.session import get_spark, ensure_checkpoint_dir, read_table  # noqa: F401

__all__ = ["get_spark", "ensure_checkpoint_dir", "read_table"]
