"""Text and number formats, freshness, depth styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.filters import interpolate

# Display labels and styles by depth, kind and evidence.
DEPTH_COLORS = ["#1B62C4", "#D98324", "#C2352B", "#7B3E9D"]
DEPTH_LABELS = ["単独指定", "二重用", "三重用", "四重用以上"]
DEPTH_WIDTHS = [1.0, 1.5, 2.0, 2.4]
KIND_LABELS = {
    "road": "車道",
    "expressway": "車道（自動車専用道路）",
    "construction": "工事中・事業中",
    "unopened": "未開通区間（計画・未着工）",
    "foot": "点線国道（徒歩道）",
    "steps": "点線国道（階段）",
    "ferry": "海上国道（航路）",
}
SOURCE_LABELS = {"relation": "ルートリレーション", "name": "名称（国道N号）", "tag": "ref タグ（リレーション未登録）"}
ZOOM_WIDTHS = [(6, 0.9), (9, 1.8), (12, 3.2), (15, 6.0)]
SIGN_WIDTHS = [115, 247, 332]
STALE_DAYS = 7


def escape(text: Column) -> Column:
    """The five signs of HTML; the ampersand first, so that nothing is escaped twice. Null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def fixed(x: Column, digits: int) -> Column:
    """A decimal with so many places, halves up. Lengths are decimals, so no binary fraction is involved."""
    return F.round(x.cast("decimal(28,6)"), digits).cast(f"decimal(28,{digits})").cast("string")


def grouped(x: Column) -> Column:
    """A whole number with thousands separators, halves up."""
    return F.format_number(F.round(x.cast("decimal(28,6)"), 0), 0)


def count_label(shown: Column, total: Column, unit: str = "組") -> Column:
    return F.when(total > 0, F.concat_ws(" ", shown, F.lit("/"), total, F.lit(unit))).otherwise("")


def clear_label(count: Column) -> Column:
    return F.when(count > 0, F.concat(count.cast("string"), F.lit(" 路線を選択解除"))).otherwise("選択解除")


def selected_or_all(count: Column, total: Column) -> Column:
    return F.coalesce(F.nullif(count, F.lit(0)), total)


def depth_badge(max_n: Column) -> Column:
    return F.when(max_n > 1, F.concat(F.lit("×"), max_n.cast("string")))


def depth_text(refs: Column) -> Column:
    return F.when(F.size(refs) > 1, F.concat(F.size(refs).cast("string"), F.lit(" 重用"))).otherwise("単独指定")


def or_dash(text: Column) -> Column:
    return F.coalesce(F.nullif(text.cast("string"), F.lit("")), F.lit("—"))


def label_of(key: Column, labels: dict[str, str]) -> Column:
    """The label, or the key itself where there is none."""
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in labels.items()), key)


def by_depth(n: Column, values: list) -> Column:
    """One of four values for 1, 2, 3 and anything else."""
    return F.when(n == 1, F.lit(values[0])).when(n == 2, F.lit(values[1])).when(n == 3, F.lit(values[2])).otherwise(F.lit(values[3]))


def line_width(zoom: Column, n: Column, add: float = 0.0, scale: bool = True) -> Column:
    """Width between zoom stops, scaled by depth."""
    factor = by_depth(n, DEPTH_WIDTHS) if scale else F.lit(1.0)
    return interpolate(zoom, [(z, F.lit(w) * factor + F.lit(add)) for z, w in ZOOM_WIDTHS])


def text_size(zoom: Column) -> Column:
    return interpolate(zoom, [(8, F.lit(12.0)), (13, F.lit(16.0))])


def end_radius(zoom: Column, shared: Column) -> Column:
    pick = lambda a, b: F.when(shared == 1, F.lit(a)).otherwise(F.lit(b))
    return interpolate(zoom, [(7, pick(5.0, 3.0)), (13, pick(9.0, 5.0))])


def sign_width(ref: Column) -> Column:
    digits = F.length(ref.cast("string"))
    return F.when(digits >= 3, SIGN_WIDTHS[2]).when(digits == 2, SIGN_WIDTHS[1]).otherwise(SIGN_WIDTHS[0])


def age_days(now: Column, base: Column) -> Column:
    """Whole days elapsed, not calendar days."""
    return F.floor((F.unix_millis(now) - F.unix_millis(base)) / 86_400_000)


def age_text(days: Column) -> Column:
    return F.when(days <= 0, "当日").when(days == 1, "1 日前").otherwise(F.concat(days.cast("string"), F.lit(" 日前")))


def is_stale(days: Column) -> Column:
    return days > STALE_DAYS


def utc_minute(ts: Column) -> Column:
    """2026-08-16 20:21Z; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm'Z'")


def way_url(id_: Column) -> Column:
    return F.concat(F.lit("https://www.openstreetmap.org/way/"), escape(id_))


def numbers_text(*values: Column) -> Column:
    """Numbers as a comma list ('138,36,139,37' or 'lon,lat')."""
    return F.concat_ws(",", *(F.regexp_replace(v.cast("string"), r"\.0$", "") for v in values))


def parse_numbers(text: Column) -> Column:
    """A comma list back to its numbers; what is no number is null, an empty text has none."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda p: p != "")
    return F.transform(parts, lambda p: p.try_cast("double"))


#: The closest zoom for a place and for a box, which may have no extent.
PLACE_ZOOM, BOX_ZOOM = 12, 14


def names_text(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.array_join(names, " / "))


def bare_tasks(text: Column) -> Column:
    """Names of a task file's tasks whose script has several lines while no shell is named."""
    sections = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=\[[a-z])"), lambda s: s.startswith("[tasks."))
    script = lambda s: F.regexp_extract(s, r'(?s)\nrun = """(.*?)"""', 1)
    several = lambda s: F.size(F.filter(F.split(script(s), "\n"), lambda line: F.trim(line) != "")) > 1
    bad = F.filter(sections, lambda s: several(s) & ~s.rlike(r"(?m)^shell = "))
    return F.transform(bad, lambda s: F.regexp_extract(s, r"\A\[tasks\.([\w:-]+)\]", 1))


def code_point_hex(sign: Column) -> Column:
    """A sign's code point in hex, four digits at least."""
    text = F.lower(F.hex(F.ascii(sign)))
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)
