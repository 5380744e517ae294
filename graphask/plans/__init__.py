"""Physical-plan helpers: checked broadcasts, salted joins, lineage cuts."""

from graphask.plans.broadcast import broadcast_if_bounded, measure
from graphask.plans.lineage import cut_lineage, scratch_dir, stored, use_local_scratch
from graphask.plans.numbering import with_position
from graphask.plans.skew import HotKeys, find_hot_keys, frequent_join, salted_join

__all__ = [
    "HotKeys",
    "broadcast_if_bounded",
    "cut_lineage",
    "find_hot_keys",
    "frequent_join",
    "measure",
    "salted_join",
    "scratch_dir",
    "stored",
    "use_local_scratch",
    "with_position",
]
