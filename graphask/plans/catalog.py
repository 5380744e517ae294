"""The template catalog: which lookup answers which template.

Templates are rows, not code paths; a new question is a new row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from graphask.functions.answers import PRODUCT_CARD

PROPERTY = "property"
IMAGE = "image"
RECORD = "record"
INBOUND = "inbound"
KINDS = (PROPERTY, IMAGE, RECORD, INBOUND)

MAX_TEMPLATES = 10_000

_SCHEMA = (
    "template_id int, pattern string, kind string, label string, field string, rel string, "
    "slot int, slot_tag string"
)


class Template(NamedTuple):
    """``label`` is the node looked up, or the target of ``rel`` for an inbound lookup."""

    template_id: int
    pattern: str
    kind: str
    label: str
    field: str | None
    rel: str | None
    slot: int

    @property
    def slot_tag(self) -> str:
        return self.pattern.split(" ")[self.slot - 1]


class TemplateCatalog:
    """A bounded set of templates, plus the card clauses of each label."""

    def __init__(
        self,
        templates: Sequence[Template],
        cards: Mapping[str, Sequence[tuple[str, str]]] | None = None,
    ) -> None:
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        self.templates = list(templates)
        self.cards = dict(cards or {})

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(*t, t.slot_tag) for t in self.templates], _SCHEMA)


# The templates of the aquaculture graph, with its labels, properties and relations.
AQUACULTURE_TEMPLATES = (
    Template(0, "nap 别名", PROPERTY, "水产品", "别名", None, 1),
    Template(1, "nap 可能患有疾病", PROPERTY, "水产品", "可能患有疾病", None, 1),
    Template(2, "nap 图片", IMAGE, "水产品", "图片", None, 1),
    Template(3, "nap 栖息地", PROPERTY, "水产品", "栖息地", None, 1),
    Template(4, "nap 特征", PROPERTY, "水产品", "特征", None, 1),
    Template(5, "nap 繁殖季节", PROPERTY, "水产品", "繁殖季节", None, 1),
    Template(6, "nap 育苗场地", PROPERTY, "水产品", "育苗场地", None, 1),
    Template(7, "nap 饲养饵料", PROPERTY, "水产品", "饲养饵料", None, 1),
    Template(8, "nba 营养成分", PROPERTY, "饲养饵料", "营养成分", None, 1),
    Template(9, "ndi 病因", PROPERTY, "疾病", "病因", None, 1),
    Template(10, "ndi 症状", PROPERTY, "疾病", "症状", None, 1),
    Template(11, "ndi 防治方法", PROPERTY, "疾病", "防治方法", None, 1),
    Template(12, "neq 作用", PROPERTY, "池塘设备", "作用", None, 1),
    Template(13, "nve 池塘设备", PROPERTY, "育苗场地", "池塘设备", None, 1),
    Template(14, "nve 池深", PROPERTY, "育苗场地", "池深", None, 1),
    Template(15, "nve 面积", PROPERTY, "育苗场地", "面积", None, 1),
    Template(16, "napl 成长", PROPERTY, "水产品幼体", "成长", None, 1),
    Template(17, "napl 饲养饵料", PROPERTY, "水产品幼体", "饲养饵料", None, 1),
    Template(18, "养殖于 nve", INBOUND, "育苗场地", None, "养殖于", 2),
    Template(19, "可能患有 ndi", INBOUND, "疾病", None, "可能患有疾病", 2),
    Template(20, "成长为 nap", INBOUND, "水产品", None, "成长", 2),
    Template(21, "成长为 napl", INBOUND, "水产品幼体", None, "成长", 2),
    Template(22, "投喂 nba", INBOUND, "饲养饵料", None, "投喂", 2),
    Template(23, "栖息于 nha", INBOUND, "栖息地", None, "栖息于", 2),
    Template(24, "需要配备 neq", INBOUND, "池塘设备", None, "需要配备", 2),
    Template(25, "nap 所有信息", RECORD, "水产品", None, None, 1),
)
TIPS_LABEL = "水产品"


def aquaculture_catalog() -> TemplateCatalog:
    return TemplateCatalog(AQUACULTURE_TEMPLATES, {"水产品": PRODUCT_CARD})
