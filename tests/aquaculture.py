"""A small invented graph, dictionary and corpus in the aquaculture schema."""

from pyspark.sql import SparkSession

from graphask import schemas
from graphask.plans.catalog import AQUACULTURE_TEMPLATES

NODES = [
    (1, "水产品", "草鱼", {
        "别名": "鲩鱼", "可能患有疾病": "赤皮病", "图片": "http://img/1.jpg", "栖息地": "江", "特征": "体长",
        "繁殖季节": "春季", "育苗场地": "草鱼塘", "饲养饵料": "水草",
    }),
    (2, "水产品", "鲤鱼", {"别名": "\\N", "特征": "有须"}),
    (3, "饲养饵料", "水草", {"营养成分": "纤维"}),
    (4, "疾病", "赤皮病", {"病因": "细菌", "症状": "发红", "防治方法": "消毒"}),
    (5, "池塘设备", "潜水泵", {"作用": "抽水"}),
    (6, "育苗场地", "草鱼塘", {"面积": "2亩", "池深": "1.5米", "池塘设备": "潜水泵"}),
    (7, "水产品幼体", "草鱼鱼苗", {"成长": "草鱼", "饲养饵料": "轮虫"}),
    (8, "栖息地", "江", {}),
    (9, "水产品幼体", "草鱼受精卵", {"成长": "草鱼鱼苗"}),
    (10, "水产品", "草鱼", {"别名": "第二条"}),
    (11, "栖息地", "水库", {}),
]
EDGES = [
    (1, "养殖于", 6),
    (1, "可能患有疾病", 4),
    (2, "可能患有疾病", 4),
    (7, "成长", 1),
    (9, "成长", 7),
    (1, "投喂", 3),
    (1, "栖息于", 8),
    (2, "栖息于", 8),
    (6, "需要配备", 5),
]
DICTIONARY = [
    ("草鱼", "nap", 0, 0),
    ("鲤鱼", "nap", 0, 0),
    ("鲫鱼", "nap", 0, 0),
    ("水草", "nba", 0, 1),
    ("无节幼体", "nba", 0, 1),
    ("赤皮病", "ndi", 0, 2),
    ("潜水泵", "neq", 0, 3),
    ("江", "nha", 0, 4),
    ("水库", "nha", 0, 4),
    ("草鱼塘", "nve", 0, 5),
    ("草鱼鱼苗", "napl", 0, 6),
    ("草鱼受精卵", "napl", 0, 6),
    ("无节幼体", "napl", 0, 6),
]
_PHRASINGS = {
    0: ["nap俗称是什么", "nap有哪些别称"],
    1: ["nap容易患什么疾病", "nap会染上哪些病害"],
    2: ["nap的照片", "给我看nap的图片"],
    3: ["nap住在哪里", "nap在哪里生活"],
    4: ["nap有什么特点", "nap的特征"],
    5: ["nap什么季节繁殖", "nap的繁殖季节"],
    6: ["nap在哪里育苗", "nap的育苗场地"],
    7: ["nap吃什么", "用什么喂养nap"],
    8: ["nba含有什么营养", "nba的营养成分"],
    9: ["ndi的病因", "ndi是什么引起的"],
    10: ["ndi有什么症状", "ndi的临床表现"],
    11: ["ndi如何防治", "怎样治疗ndi"],
    12: ["neq有什么作用", "neq的功能"],
    13: ["nve需要哪些设备", "nve配备什么设备"],
    14: ["nve有多深", "nve的池深"],
    15: ["nve面积多大", "nve的占地面积"],
    16: ["napl会长大成什么", "napl的成长"],
    17: ["napl吃什么", "napl的饲料"],
    18: ["哪些养殖于nve", "nve里养什么"],
    19: ["哪些会得ndi", "谁可能患有ndi"],
    20: ["什么成长为nap", "哪些长大后是nap"],
    21: ["什么成长为napl", "哪些长大后是napl"],
    22: ["nba可以喂养哪些", "哪些投喂nba"],
    23: ["哪些栖息于nha", "nha里有什么鱼"],
    24: ["哪些场地需要neq", "neq用在哪些场地"],
    25: ["nap的全部信息", "关于nap的数据"],
}
SAMPLES = [(label, sentence) for label, sentences in _PHRASINGS.items() for sentence in sentences]
_WORDS = (
    "nap napl nba ndi neq nha nve 俗称 什么 哪些 别称 容易 患 疾病 染上 病害 照片 图片 住 在 哪里 生活 特点 特征 季节 繁殖 "
    "育苗 场地 吃 喂养 含有 营养 成分 病因 引起 症状 临床 表现 如何 防治 怎样 治疗 作用 功能 需要 设备 配备 深 池深 面积 大 "
    "占地 长大 成长 饲料 养殖于 养 得 谁 可能 患有 成长为 后 可以 投喂 栖息于 里 鱼 用 全部 信息 关于 数据 多"
).split()


def tables(spark: SparkSession) -> dict:
    return {
        "nodes": spark.createDataFrame(NODES, schemas.NODES),
        "edges": spark.createDataFrame(EDGES, schemas.EDGES),
        "dictionary": spark.createDataFrame(DICTIONARY, schemas.DICTIONARY),
        "vocabulary": spark.createDataFrame(list(enumerate(_WORDS)), schemas.VOCABULARY),
        "samples": spark.createDataFrame(SAMPLES, schemas.SAMPLES),
    }


TEMPLATE_IDS = [t.template_id for t in AQUACULTURE_TEMPLATES]
