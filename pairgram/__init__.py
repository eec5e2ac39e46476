"""pairgram: text-pair feature analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame. Nothing is
collected to the driver; per-pair work is partitioned by the pair key.
"""

from pairgram.session import get_spark, shared_dir, ensure_checkpoint_dir

__all__ = ["get_spark", "shared_dir", "ensure_checkpoint_dir"]
