"""Text expressions on built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import lexicon as L


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """Line ends as LF, three and more LF as two, stripped."""
    return _strip(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\n{3,}", "\n\n"))


def headings(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?m)^#{1,6}\s+"))


def drop_noise(c: Column) -> Column:
    for p in L.NOISE:
        c = F.regexp_replace(c, p, "")
    return _strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def sentences(c: Column, least: int = 0) -> Column:
    """Split after . ! ? and blanks; pieces of fewer than ``least`` characters go."""
    parts = F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.trim(x))
    return F.filter(parts, lambda s: F.length(s) >= least)


def sentences_cjk(c: Column, longer_than: int = 3, semicolons: bool = False) -> Column:
    p = r"(?<=[。！？.!?;；])\s*" if semicolons else r"(?<=[。！？.!?])\s*"
    return F.filter(F.transform(F.split(c, p), lambda x: F.trim(x)), lambda s: F.length(s) > longer_than)


def title(source_file: Column, text: Column) -> Column:
    named = F.replace(F.regexp_replace(source_file, r"\.md$", ""), F.lit("_"), F.lit(" "))
    first = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda s: (F.length(s) > 0) & (F.length(s) < 100))
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)), F.lit("")), F.try_element_at(first, F.lit(1)), F.lit("未命名文档"))


def alias_entities(text: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """Canonical names any alias of which the text contains, and `quoted code`, sorted."""
    low = F.lower(text)
    found = [F.when(F.lit(False) | _any(low, [a.lower() for a in al]), F.lit(c)) for c, al in (aliases or L.ALIASES).items()]
    code = F.transform(F.regexp_extract_all(text, F.lit("`([^`]+)`"), 1), lambda x: F.trim(x))
    return F.array_sort(F.array_union(F.array_compact(F.array(*found)), code))


def _any(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def canonical(entity: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    flat = {a.lower(): c for c, al in (aliases or L.ALIASES).items() for a in [c, *al]}
    m = F.create_map(*[F.lit(x) for kv in flat.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(entity)), entity)


def keyword_tokens(text: Column) -> Column:
    """Runs of two or more Han characters, then of Latin letters, then of digits, without stop words."""
    low = F.lower(text)
    zh = F.filter(F.regexp_extract_all(low, F.lit(r"[一-鿿]{2,}"), 0), lambda t: ~t.isin(L.STOP_ZH))
    en = F.filter(F.regexp_extract_all(low, F.lit(r"[a-z]{2,}"), 0), lambda t: ~t.isin(L.STOP_EN))
    return F.concat(zh, en, F.regexp_extract_all(low, F.lit(r"\d{2,}"), 0))


def query_keywords(text: Column, most: int = 20) -> Column:
    """Up to ``most`` distinct terms in order of appearance, of equal weight."""
    terms = F.slice(F.array_distinct(keyword_tokens(text)), 1, most)
    return F.map_from_entries(F.transform(terms, lambda t: F.struct(t.alias("key"), F.round(F.lit(1.0) / F.size(terms), 6).alias("value"))))


def term_gravity(query: Column, weights: Column) -> Column:
    """Share of the query's squared weight that the text's weights meet, at most 1."""
    e = F.map_entries(query)
    q2 = F.aggregate(e, F.lit(0.0), lambda s, x: s + x["value"] * x["value"])
    hit = F.aggregate(e, F.lit(0.0), lambda s, x: s + x["value"] * F.coalesce(F.try_element_at(weights, x["key"]), F.lit(0.0)))
    return F.when((F.size(e) == 0) | (q2 == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), hit / q2))


def time_of(source_file: Column, text: Column, created_at: Column) -> Column:
    """Date in the file name (and clock in the head of the text), else in the head of the text, else of creation, else ''."""
    day = F.regexp_extract(source_file, r"(\d{4}-\d{2}-\d{2})", 1)
    clock = F.regexp_extract(F.substring(text, 1, 80), r"(\d{1,2}:\d{2})", 1)
    head = F.substring(text, 1, 100)
    iso = F.regexp_extract(head, r"(\d{4}-\d{2}-\d{2})", 1)
    slash = F.regexp_extract(head, r"(\d{4}/\d{2}/\d{2})", 1)
    zh = r"(\d{4})年(\d{1,2})月(\d{1,2})日"
    y, m, d = (F.regexp_extract(head, zh, i) for i in (1, 2, 3))
    return (
        F.when((day != "") & (clock != ""), F.concat(day, F.lit(" ("), clock, F.lit(")")))
        .when(day != "", day)
        .when(iso != "", iso)
        .when(slash != "", slash)
        .when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
        .otherwise(F.substring(F.coalesce(created_at, F.lit("")), 1, 10))
    )


def is_chatter(line: Column) -> Column:
    s = F.trim(line)
    return (
        s.rlike(r"(?i)^>\s*(工具|Tool|exec|process|read|write|edit):")
        | s.isin("```", "```python", "```json", "```bash", "```yaml")
        | s.rlike(r"^#+\s*(ASSISTANT|USER|TOOL|💭|思考|System)\b")
        | s.rlike(r"^[-=]{5,}$")
    )


def summary(text: Column, most: int = 150) -> Column:
    """Lines that carry content, as one line, cut after the last full stop in the second half, else with '...'."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~is_chatter(x))
    full = F.trim(F.regexp_replace(F.array_join(lines, " "), r"\s+", " "))
    head = F.substring(full, 1, most)
    last = F.length(F.regexp_extract(head, r"(?s)^(.*[。.！？])", 1))
    cut = F.when(last - 1 > most // 2, F.substring(head, F.lit(1), last)).otherwise(F.concat(head, F.lit("...")))
    return F.when(full == "", F.trim(F.substring(text, 1, most))).when(F.length(full) <= most, full).otherwise(cut)


def context_line(i: Column, source_type: Column, time: Column, topics: Column, summary_: Column) -> Column:
    return F.format_string("[第%d段] %s | %s\n  主题: %s\n  摘要: %s", i, source_type, time, F.array_join(topics, ", "), summary_)


def rewrite_strategy(source_type: Column, full: list[str], light: list[str]) -> Column:
    return F.when(source_type.isin(full), "full").when(source_type.isin(light), "light").otherwise("full")


def source_type_of(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    m = F.create_map(*[F.lit(x) for kv in L.SOURCE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, ext), F.lit(L.SOURCE_TYPE_OTHER))


def default_type(given: Column, headings_: Column) -> Column:
    return F.when(F.coalesce(given, F.lit("")) != "", given).when(headings_ > 0, "技术笔记").otherwise("其他")


def score_of_reply(reply: Column) -> Column:
    """A number from 1 to 5, else the first digit 1-5 in the reply, as a share of 5; null without one."""
    whole = F.try_to_number(F.trim(reply), F.lit("9.99")).cast("double")
    digit = F.regexp_extract(reply, r"([1-5])", 1)
    return F.when((whole >= 1) & (whole <= 5), whole / 5).when(digit != "", digit.cast("double") / 5)


def json_of_reply(reply: Column) -> Column:
    """The reply if it is JSON, else its first fenced JSON block, else null."""
    block = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    ok = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(ok(reply), reply).when((block != "") & ok(block), block)


def history(rounds: Column) -> Column:
    """Rounds of (role, content) as lines, joined by blank lines."""
    return F.array_join(F.transform(rounds, lambda r: F.concat(F.when(r["role"] == "user", "Human: ").otherwise("Assistant: "), r["content"])), "\n\n")


def prompt(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("[第"), (i + 1).cast("string"), F.lit("段] "), p)), "\n\n---\n\n")


def clean_references(text: Column) -> Column:
    """Without (… 2019) and [1,2]; blanks collapsed."""
    t = F.regexp_replace(F.regexp_replace(text, r"\([^)]*\d{4}[^)]*\)", ""), r"\[\d+(?:,\s*\d+)*\]", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def file_name(title_: Column) -> Column:
    return F.substring(F.regexp_replace(title_, r'[\\/:*?"<>|]', "_"), 1, 100)


def doc_terms_fallback(text: Column) -> Column:
    return F.slice(F.filter(F.transform(F.split(F.substring(text, 1, 500), "。"), lambda x: F.trim(x)), lambda s: F.length(s) > 5), 1, 3)


def frequent_words(text: Column) -> Column:
    """Words of the first 500 characters that may stand for entities, with repeats."""
    return F.filter(F.regexp_extract_all(F.substring(text, 1, 500), F.lit(r"[一-鿿A-Za-z]{2,}"), 0), lambda w: ~w.isin(L.STOP_ENTITY))


def heading(text: Column) -> Column:
    """struct(level, title) of the first heading of two signs and more in the first 200 characters, else null."""
    head = F.substring(text, 1, 200)
    marks, name = F.regexp_extract(head, r"(?m)^##(#*)\s+(.+)$", 1), F.regexp_extract(head, r"(?m)^##(#*)\s+(.+)$", 2)
    return F.when(name != "", F.struct((F.length(marks) + 1).alias("level"), F.trim(name).alias("title")))


# -- norms and masses -------------------------------------------------------------------------------------------


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def norm_of_mass(mass: Column) -> Column:
    x = (clip(mass, 1, 3) - 1) / 2
    return F.round(0.1 + 0.5 * (1 - x), 4)


def norm_of_level(level: Column) -> Column:
    return F.when(level == 1, 0.15).when(level == 2, 0.50).when(level == 3, 0.80).otherwise(0.50)


def norm_of_degree(degree: Column, largest: Column) -> Column:
    return F.when(largest == 0, F.lit(0.80)).otherwise(clip(0.80 - 0.65 * degree / largest, 0.15, 0.80))


def norm_of_density(mean_ip: Column) -> Column:
    return clip(0.80 - 0.65 * clip((mean_ip + 1) / 2, 0, 1), 0.15, 0.80)


def fused_radius(hier: Column, hub: Column, density: Column, weights: tuple[float, float, float] = (0.25, 0.25, 0.5)) -> Column:
    return F.round(clip(weights[0] * hier + weights[1] * hub + weights[2] * density, 0.05, 0.90), 4)


def jump_confidence(occurrences: Column, roles: Column) -> Column:
    return clip(0.5 + F.when(occurrences >= 5, 0.2).when(occurrences >= 3, 0.1).otherwise(0.0) + 0.08 * roles, 0.3, 0.95)


def query_norm(query: Column) -> Column:
    return clip(0.9 - 0.05 * F.size(F.filter(F.split(query, r"\s+"), lambda w: w != "")), 0.1, 0.9)


def cluster_label(cluster_id: Column, names: dict[int, str] | None = None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in (names or {}).items() for x in kv]) if names else F.lit(None).cast("map<int,string>")
    return F.coalesce(F.try_element_at(m, cluster_id), F.concat(F.lit("簇"), cluster_id.cast("string")))
