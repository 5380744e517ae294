"""Answer formatting as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts and formats of the answers.
NAME_SEPARATOR = "、"
TIPS_PREFIX = "当前可查询的水产品包括："
NOT_FOUND_TEXT = "抱歉,我没有找到你要的答案"
ERROR_TEXT = "系统繁忙，请稍后重试..."
IMAGE_FORMAT = (
    '<a target="_blank" rel="noopener noreferrer" href="%1$s"><img src="%1$s" title="点击查看大图"></a>'
)
# One clause per property of a product card: (property, format).
PRODUCT_CARD = (
    ("别名", "别名'%s'。"),
    ("特征", "它的特征是'%s'。"),
    ("育苗场地", "养殖时一般在'%s'育苗。"),
    ("繁殖季节", "它的繁殖季节是'%s'。"),
    ("栖息地", "栖息于'%s'。"),
    ("饲养饵料", "用'%s'来饲养。"),
    ("可能患有疾病", "养殖过程中，它可能感染'%s'等疾病，您可以通过查询疾病的相关信息进行判断和防治。"),
    ("图片", "<br>以下是它的图片：" + IMAGE_FORMAT),
)

NULL_MARKER = "\\N"

OK = "ok"
NOT_FOUND = "not_found"
NO_SLOT = "no_slot"
ERROR = "error"


def join_names(names: Column) -> Column:
    """Names joined with the list separator; null for an empty list."""
    return F.when(F.size(names) > 0, F.array_join(names, NAME_SEPARATOR))


def tips(names: Column) -> Column:
    return F.concat(F.lit(TIPS_PREFIX), join_names(names))


def image(url: Column) -> Column:
    """Link and image tag around a url; null without one."""
    return F.when(url.isNotNull(), F.format_string(IMAGE_FORMAT, url))


def present(answer: Column) -> Column:
    """The answer, or null when it is null, empty or the null marker."""
    return F.nullif(F.nullif(answer, F.lit("")), F.lit(NULL_MARKER))


def card(name: Column, props: Column, clauses: Sequence[tuple[str, str]] = PRODUCT_CARD) -> Column:
    """The name followed by one clause per present property; null when there is no record."""
    values = [(present(props[field]), fmt) for field, fmt in clauses]
    parts = [F.when(value.isNotNull(), F.format_string(fmt, value)) for value, fmt in values]
    return F.when(props.isNotNull(), F.concat(name, F.concat_ws("", *parts)))


def status_of(answer: Column, has_slot: Column, well_formed: Column) -> Column:
    return (
        F.when(~well_formed, ERROR)
        .when(~has_slot, NO_SLOT)
        .when(present(answer).isNull(), NOT_FOUND)
        .otherwise(OK)
    )


def answer_text(answer: Column, status: Column) -> Column:
    """The text that is shown: the answer itself, the apology or the busy text."""
    return (
        F.when(status == OK, answer)
        .when(status == ERROR, F.lit(ERROR_TEXT))
        .otherwise(F.lit(NOT_FOUND_TEXT))
    )
