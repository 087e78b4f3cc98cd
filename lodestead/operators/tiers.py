"""The tier that a device can run, as a column expression over a table of what devices say of themselves."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestead.config import TIERS
from lodestead.functions.text import col

#: Bytes of a buffer and of a binding for the small tier, bytes of a buffer and gigabytes of memory for the standard one.
SMALL_BUFFER, SMALL_BINDING, STANDARD_BUFFER, STANDARD_MEMORY = 256 << 20, 128 << 20, 1 << 30, 8


def tier(ceiling: Column | str) -> Column:
    """struct (tier, reason, capped) of rows (webgpu, save_data, effective_type, max_buffer, max_binding, memory_gb).

    The first obstacle there is leaves retrieval alone. Null limits and null memory are no obstacle, but the standard tier
    asks for a buffer that is known to be large. capped: the device could run more than the ceiling.
    """
    obstacles = F.coalesce(
        F.when(~F.coalesce("webgpu", F.lit(False)), "no graphics processor"),
        F.when(F.coalesce("save_data", F.lit(False)), "data is to be saved"),
        F.when(F.col("effective_type").isin("slow-2g", "2g"), "slow connection"),
        F.when((F.col("max_buffer") < SMALL_BUFFER) | (F.col("max_binding") < SMALL_BINDING), "limits too small"),
    )
    large = F.coalesce(F.col("max_buffer") >= STANDARD_BUFFER, F.lit(False)) & F.coalesce(F.col("memory_gb") >= STANDARD_MEMORY, F.lit(True))
    rank = F.when(obstacles.isNotNull(), 0).when(large, 2).otherwise(1)
    names = F.array(*map(F.lit, TIERS))
    most = F.array_position(names, col(ceiling)).cast("int") - 1
    return F.struct(F.get(names, F.least(rank, most)).alias("tier"), F.coalesce(obstacles, F.when(large, "large limits").otherwise("graphics processor")).alias("reason"), (rank > most).alias("capped"))
