"""Cleaning of text values as column expressions; a value that cannot be read gives null and, where asked, an issue code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for true and false.
TRUE_WORDS = ("1", "true", "yes", "y", "co", "có", "x")
FALSE_WORDS = ("0", "false", "no", "n", "khong", "không")
#: Unit aliases of planning (forecast side).
PLANNING_UNITS = {
    "g": ("g", "gram", "grams"),
    "kg": ("kg", "kilogram", "kilograms"),
    "ml": ("ml", "milliliter", "milliliters", "millilitre", "millilitres"),
    "liter": ("l", "liter", "liters", "litre", "litres"),
    "unit": ("unit", "units", "piece", "pieces", "pc", "pcs", "each", "item", "items", "cup", "cups", "ly", "serving", "servings"),
    "pack": ("pack", "packs", "package", "packages"),
}
#: Unit aliases of raw files, with local words.
IMPORT_UNITS = {
    "kg": ("kg", "kilogram", "kilograms"),
    "g": ("g", "gram", "grams"),
    "liter": ("l", "liter", "litre", "liters", "litres", "lít", "lit"),
    "ml": ("ml", "milliliter", "millilitre"),
    "unit": ("cái", "cai", "piece", "pieces", "unit", "ly", "cup"),
    "pack": ("thùng", "thung", "bao", "gói", "goi", "chai", "pack"),
}
#: Letters with marks, by their plain letter.
MARKED = {
    "a": "àáạảãâầấậẩẫăằắặẳẵäå", "e": "èéẹẻẽêềếệểễë", "i": "ìíịỉĩîï", "o": "òóọỏõôồốộổỗơờớợởỡö",
    "u": "ùúụủũưừứựửữûü", "y": "ỳýỵỷỹÿ", "c": "ç", "n": "ñ",
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean(c: Column) -> Column:
    """Trimmed text; empty is null."""
    return F.nullif(F.trim(c), F.lit(""))


def plain_letters(c: Column) -> Column:
    """Lower case without marks on letters."""
    marked = "".join(MARKED.values())
    return F.translate(F.lower(c), marked, "".join(k * len(v) for k, v in MARKED.items()))


def text_key(c: Column) -> Column:
    """Lower case, no marks, every other character run one underscore; d with stroke is such a character."""
    t = F.trim(F.coalesce(c, F.lit("")))
    key = F.regexp_replace(F.regexp_replace(plain_letters(t), "[^a-z0-9]+", "_"), "^_|_$", "")
    return F.when(t.rlike("^[A-Za-z0-9]+$"), F.lower(t)).otherwise(key)  # most names are one plain word


def entity_key(c: Column) -> Column:
    """As text_key, with d for d with stroke and spaces for underscores."""
    return F.trim(F.regexp_replace(F.translate(plain_letters(F.coalesce(c, F.lit(""))), "đ", "d"), "[^a-z0-9]+", " "))


def stable_id(prefix: str, c: Column, sha: int = 1) -> Column:
    """prefix_ and the first 12 hex digits of SHA-1 (planning) or SHA-256 (imports) of the key."""
    digest = F.sha1(text_key(c)) if sha == 1 else F.sha2(entity_key(c), 256)
    return F.concat(F.lit(f"{prefix}_"), F.substring(digest, 1, 12))


def parse_boolean(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def _number(c: Column) -> Column:
    """number and issue of a text, read once."""

    def marked(t: Column) -> Column:
        commas, dots = F.length(t) - F.length(F.replace(t, F.lit(","))), F.length(t) - F.length(F.replace(t, F.lit(".")))
        comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
        return let(F.struct(t.alias("t"), commas.alias("commas"), dots.alias("dots"), comma_last.alias("comma_last")), read)

    def read(x: Column) -> Column:
        t, commas, dots = x["t"], x["commas"], x["dots"]
        plain = F.when((commas > 0) & (dots > 0), F.when(x["comma_last"], F.translate(t, ",.", ".")).otherwise(F.translate(t, ",", ""))).otherwise(F.translate(t, ",", "."))
        tail = F.length(F.substring_index(F.translate(t, ",", "."), ".", -1))
        unclear = ((commas > 0) != (dots > 0)) & ((commas + dots > 1) | (tail == 3))
        return let(F.struct(plain.try_cast("double").alias("number"), unclear.alias("unclear"), (t == "").alias("empty")), judged)

    def judged(x: Column) -> Column:
        issue = F.when(x["empty"], None).when(x["unclear"], "NUMBER_SEPARATOR_AMBIGUOUS").when(x["number"].isNull(), "NUMBER_INVALID")
        return F.struct(F.when(~x["unclear"], x["number"]).alias("number"), issue.alias("issue"))

    return let(F.replace(F.coalesce(clean(c), F.lit("")), F.lit(" "), F.lit("")), marked)


def number_issue(c: Column) -> Column:
    """AMBIGUOUS where one separator could group thousands, INVALID where no number is left, else null."""
    return _number(c)["issue"]


def parse_number(c: Column) -> Column:
    """Number with either decimal separator; null where number_issue has a code."""
    return _number(c)["number"]


ISO_DATE, LOCAL_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}-\d{1,2}-\d{4}$"


def _date(c: Column, locale: str | None) -> Column:
    """date and issue of a text, read once."""

    def local(t: Column) -> Column:
        cells = F.transform(F.split(t, "-"), lambda x: x.try_cast("int"))

        def made(n: Column) -> Column:
            clear = (n[0] > 12) | (n[1] > 12) if locale is None else F.lit(True)
            day_first = n[0] > 12 if locale is None else F.lit(locale == "DMY")
            month, day = F.when(day_first, n[1]).otherwise(n[0]), F.when(day_first, n[0]).otherwise(n[1])
            date = F.concat_ws("-", F.lpad(n[2].cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")
            return F.struct(F.when(clear, date).alias("date"), (~clear).alias("unclear"))

        return let(cells, made)

    def read(t: Column) -> Column:
        none = F.lit(None).cast("date")
        return F.when(t.rlike(ISO_DATE), F.struct(t.try_cast("date").alias("date"), F.lit(False).alias("unclear"))).when(t.rlike(LOCAL_DATE), local(t)).otherwise(F.struct(none.alias("date"), F.lit(False).alias("unclear")))

    return let(F.translate(clean(c), "/", "-"), read)


def parse_date(c: Column, locale: str | None = None) -> Column:
    """ISO dates, or day/month/year by ``locale`` (DMY, MDY); without a locale only where one part exceeds 12."""
    return _date(c, locale)["date"]


def date_issue(c: Column, locale: str | None = None) -> Column:
    """AMBIGUOUS where day and month could be exchanged, INVALID where no date is left, else null."""
    return let(_date(c, locale), lambda x: F.when(clean(c).isNull(), None).when(x["unclear"], "DATE_LOCALE_AMBIGUOUS").when(x["date"].isNull(), "DATE_INVALID"))


def normalize_unit(c: Column, aliases: dict[str, tuple[str, ...]] = PLANNING_UNITS) -> Column:
    """Canonical unit of an alias; an unknown unit is kept in lower case."""
    t = F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_")) if aliases is PLANNING_UNITS else F.lower(clean(c))
    return reduce(lambda out, kv: out.when(t.isin(*kv[1]), kv[0]), list(aliases.items())[1:], F.when(t.isin(*next(iter(aliases.values()))), next(iter(aliases)))).otherwise(t)


def parse_weekdays(c: Column) -> Column:
    """Sorted weekday numbers (Monday 0) of a list like "thứ 2, 4; CN"; null if a part is unknown."""
    t = F.replace(F.replace(F.replace(F.lower(F.trim(c)), F.lit("chủ nhật"), F.lit("cn")), F.lit("thứ"), F.lit("")), F.lit("thu"), F.lit(""))
    days = F.transform(F.split(t, "[,;/]"), lambda x: F.when(F.trim(x).isin("cn", "sunday"), 6).when(F.trim(x).rlike("^[2-7]$"), F.trim(x).try_cast("int") - 2))
    return F.when(~F.exists(days, lambda d: d.isNull()), F.array_sort(F.array_distinct(days)))


def all_tokens(c: Column) -> Column:
    """Words of letters, digits, underscore, dot and hyphen, in lower case and in order; letters of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)[\w.-]+"), F.lit(0))


def tokens(c: Column) -> Column:
    """The distinct words of all_tokens."""
    return F.array_distinct(all_tokens(c))


#: The pattern of a what-if question, and the phrases of each intent in the order in which they are tried. A text has an
#: intent if it holds a phrase of each of its groups.
WHAT_IF = r"\bwhat\s+if\b|\bif demand\b|\bincrease\s+\d+%|\bdecrease\s+\d+%|(?U)\bnếu\b|(?U)\bgiả sử\b|(?U)\btăng\s+\d+%|(?U)\bgiảm\s+\d+%"
LOT = ("lot", "lots", "lô")
INTENTS = (
    ("stress", ("stress",)),
    ("forecast_availability", ("forecast evidence", "forecast explanation evidence", "bằng chứng dự báo", "dữ liệu dự báo"), ("unavailable", "not supplied", "missing", "không có", "chưa cung cấp")),
    ("readiness", ("reliable", "confidence", "complete", "đáng tin", "tin cậy", "đến đâu")),
    ("immediate_order", ("order now", "ordered now", "buy now", "mua gì", "đặt gì", "cần mua bao nhiêu", "mua bao nhiêu", "đặt hàng gì ngay bây giờ")),
    ("rejection", ("rejected", "reject", "failed", "bị loại", "thất bại")),
    ("recommendation", ("critic",), ("validate", "validated", "validation", "pass", "passed")),
    ("ingredient", ("ingredient", "recipe", "contribute", "nguyên liệu", "công thức", "đến từ sản phẩm nào")),
    ("lot_consumption", ("fefo", "consumed lot", "consumed lots", "lot consumption", "lô được dùng", "lô đã dùng", "tiêu thụ lô")),
    ("lot_expiry", LOT, ("expired", "expiry", "hết hạn")),
    ("lot_expiry", ("expired lot", "expired lots", "lot expiry", "inventory expiry", "lô hết hạn", "lô đã hết hạn", "hạn sử dụng")),
    ("lot_waste", LOT, ("waste", "wasted", "write-off", "write off", "bị hủy", "lãng phí")),
    ("lot_waste", ("wasted lot", "wasted lots", "lot waste", "write-off", "write off", "lô bị lãng phí", "lô bị hủy", "hao hụt")),
    ("inventory_ledger", ("inventory ledger", "daily ledger", "sổ kho", "nhật ký tồn kho")),
    ("inventory_risk", ("risk", "rủi ro hết hàng")),
    ("stockout", ("stockout", "shortage", "hết hàng", "thiếu hàng")),
    ("inventory_risk", ("rủi ro", "p95", "cvar")),
    ("recommendation", ("recommend", "recommended", "khuyên", "đề xuất", "why should", "được chọn", "vì sao")),
)


def intent(c: Column) -> Column:
    """The first intent whose phrases the text holds, else generic."""

    def of(t: Column) -> Column:
        holds = lambda phrases: reduce(lambda a, b: a | b, [t.contains(p) for p in phrases])
        out = F.when(t.rlike(WHAT_IF), "what_if")
        for name, *groups in INTENTS:
            out = out.when(reduce(lambda a, b: a & b, map(holds, groups)), name)
        return out.otherwise("generic")

    return let(F.lower(F.coalesce(c, F.lit(""))), of)


def guard_formula(c: Column) -> Column:
    """A text that a spreadsheet would run as a formula gets an apostrophe in front."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
