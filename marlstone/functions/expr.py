"""Scalar expressions over payload columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column, default: float) -> Column:
    """Text as a number; the default where it is none."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(default))


def status(raw: Column) -> Column:
    """Lower case; a missing status is active."""
    return F.coalesce(F.nullif(F.lower(F.trim(raw)), F.lit("")), F.lit("active"))


def node_domain(domain: Column, character: Column) -> Column:
    """The domain, else the character's name, else general; lower case, trimmed."""
    return F.lower(F.trim(F.coalesce(F.nullif(F.trim(domain), F.lit("")), F.nullif(character, F.lit("")), F.lit("general"))))


def retrievable(st: Column) -> Column:
    """Neither outdated nor archived."""
    return ~st.isin("outdated", "archived")


def in_tier(kind: Column, tier: str, logs: tuple) -> Column:
    """logs: the log types; facts: every other type, unknown ones too; anything else: all."""
    known = F.coalesce(kind, F.lit(""))
    return known.isin(*logs) if tier == "logs" else ~known.isin(*logs) if tier == "facts" else F.lit(True)


def in_scope(kind: Column, scope: str) -> Column:
    known = F.coalesce(kind, F.lit(""))
    return known == "kb_chunk" if scope == "kb" else known != "kb_chunk" if scope == "memory" else F.lit(True)


def in_domain(kind: Column, domain: Column, wanted: str) -> Column:
    """A hard domain filter that never drops knowledge-base slices."""
    return (F.coalesce(kind, F.lit("")) == "kb_chunk") | (domain == wanted)


def valid_at(at: float, since: Column, until: Column, timed: Column) -> Column:
    """Half-open validity at one instant; untimed rows and rows without a start always hold."""
    return ~timed | since.isNull() | ((since <= at) & (until.isNull() | (until > at)))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Two half-open intervals meet; an unknown start meets everything."""
    far = F.lit(float("inf"))
    return s1.isNull() | s2.isNull() | ((s1 < F.coalesce(e2, far)) & (s2 < F.coalesce(e1, far)))


def days_since(created: Column, now: float) -> Column:
    """Whole and broken days up to now, 0 for missing, non-positive and future times."""
    return F.when(created > 0, F.greatest(F.lit(0.0), (F.lit(now) - created) / 86400)).otherwise(0.0)


def soft_rerank(score: Column, kind: Column, importance: Column, days: Column, eps: float = 0.02, decay: float = 0.95) -> Column:
    """A small additive tie-break: importance around a half and age for memories, a constant for slices."""
    tilt = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (importance - 0.5) / 0.5)) + F.pow(F.lit(decay), days / 30)
    return score + eps * F.when(kind == "kb_chunk", F.lit(1.5)).otherwise(tilt)


def hard_rerank(score: Column, kind: Column, importance: Column, days: Column, decay: float = 0.95) -> Column:
    """Importance and age as factors; slices keep their score."""
    return F.when(kind == "kb_chunk", score).otherwise(score * importance * F.pow(F.lit(decay), days / 30))


def freshness(age_days: Column, scale: float, kind: str = "exp") -> Column:
    """1 for new, halved every `scale` days, or falling in a line to 0; a missing age has none."""
    value = F.pow(F.lit(0.5), age_days / scale) if kind == "exp" else F.greatest(F.lit(0.0), 1 - age_days / scale)
    return F.coalesce(value, F.lit(0.0))


def month_of(epoch: Column) -> Column:
    """'YYYY-MM' in UTC of epoch seconds, whatever the session's zone; null for missing and non-positive times."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int"))
    return F.when(epoch > 0, F.date_format(day, "yyyy-MM"))


def bucket(importance: Column) -> Column:
    return F.when(importance < 0.4, "<0.4").when(importance < 0.6, "0.4-0.6").when(importance < 0.8, "0.6-0.8").otherwise(">=0.8")


def is_digest(meta: Column, content: Column, origins: tuple, prefixes: tuple) -> Column:
    """A node that retells a dialogue: by its marked origin, else by how its content begins."""
    marked = F.coalesce(F.element_at(meta, "origin").isin(*origins), F.lit(False))
    begins = F.lit(False)
    for p in prefixes:
        begins = begins | content.startswith(p)
    return marked | begins


def meta_ok(meta: Column, most: int = 8, longest: int = 256) -> Column:
    """At most `most` keys of 1-32 letters, digits or underscores, no value missing or longer than `longest`."""
    keys = F.forall(F.map_keys(meta), lambda k: k.rlike("^[a-zA-Z0-9_]{1,32}$"))
    values = F.forall(F.map_values(meta), lambda v: v.isNotNull() & (F.char_length(v) <= longest))
    return meta.isNull() | ((F.size(meta) <= most) & keys & values)


def exact_identifier(query: Column) -> Column:
    """The query names one thing: a hash of 7 or more hex digits, an issue number or a ticket key."""
    return query.rlike(r"\b(?=[0-9a-f]*[0-9])[0-9a-f]{7,40}\b") | query.rlike(r"#\d{1,5}\b") | query.rlike(r"\b[A-Z]{2,}-\d+\b")


#: Evidence in a text and its weight, words of doubt, weights of a known path, a commit, an outdated node and doubt.
EVIDENCE = {
    r"(?i)\b(?=[0-9a-f]{7,40}\b)[0-9a-f]*[a-f][0-9a-f]*\b|\bPR\s*#\d+\b": 1.0,
    r"[A-Za-z]:[\\/][^\s，。；、）)\]]{3,}|(?<![\w/])/(?:home|mnt|tmp|d)/[^\s]{3,}": 0.8,
    r"https?://[^\s，。）)]+": 0.8,
    r"(?i)node\s*\d+|节点\s*\d+": 0.6,
    "实测|跑出来|测试通过|复跑|验证过|exit code|全绿|全过|断言": 0.7,
}
DOUBT = "待确认|待验证|存疑|未验证|无法确认|尚无定论|不确定是否|没有证据|缺乏证据|暂未核实"
W_PATH, W_COMMIT, W_OUTDATED, W_DOUBT = 0.9, 1.0, 1.0, 0.3


def opinion(content: Column, path: Column, st: Column, kind: Column, has_commit: Column) -> Column:
    """Subjective logic as struct (b, d, u) of sum 1: belief from evidence for, disbelief from evidence against, the rest uncertain."""
    on = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    r = on(F.coalesce(path, F.lit("")) != "", W_PATH) + on((kind == "git_commit") & has_commit, W_COMMIT)
    for pattern, weight in EVIDENCE.items():
        r = r + on(content.rlike(pattern), weight)
    s = on(st == "outdated", W_OUTDATED) + on(content.rlike(DOUBT), W_DOUBT)
    return F.struct((r / (r + s + 2.0)).alias("b"), (s / (r + s + 2.0)).alias("d"), (2.0 / (r + s + 2.0)).alias("u"))


def tilted(b: Column, center: float, span: float) -> Column:
    """A belief brought to -1..1 around `center`, cut off at `span`; 0 without a span."""
    return clamp((b - center) / span, -1.0, 1.0) if span > 0 else F.lit(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


#: Messages that ask for nothing, and what may follow them.
_IDLE = "yes|no|ok|okay|sure|thanks|thank you|y|n|yep|nope|yeah|nah|hi|hey|hello|yo|sup|continue|go ahead|do it|proceed|got it|cool|nice|great|done|next|lgtm|k"
_TAIL = r"[\s!?.:;,\"'~\u2018\u2019\u201c\u201d\u2014\u2013\u2026()\[\]{}<>*&^%$#@!+=`\u00a0]*"
#: Words that give a task.
_ZH_VERBS = "做|改|查|写|跑|验证|修|提|生成|整理|分析|对比"
_EN_VERBS = r"(?i)\b(?:do|make|fix|add|check|run|verify|write|build|create|review|analyze)\b"


def trivial(text: Column) -> Column:
    """Nothing, a command after a slash, or bare greeting or consent."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return (t == "") | t.startswith("/") | t.rlike(f"(?i)^(?:{_IDLE}){_TAIL}$")


def substantive(sections: Column, message: Column) -> Column:
    """A section is filled in, or the message gives a task."""
    filled = F.coalesce(F.exists(F.map_values(sections), lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""), F.lit(False))
    return filled | F.coalesce(message.rlike(_ZH_VERBS) | message.rlike(_EN_VERBS), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; 0 where one has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def space_fingerprint(*parts: Column) -> Column:
    """A short name of a vector space: provider, model, dimension, pooling."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def merge_maps(old: Column, new: Column) -> Column:
    """Shallow merge: the new map's keys win."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def shorten(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def excerpt(text: Column, most: int = 400) -> Column:
    """Verbatim beginning of at most `most` characters.

    Up to the last sentence or line end (a point between digits is none, a line
    end is left off) if that is not in the first half; else up to the last
    blank or comma, if that is not; else cut.
    """
    ahead, head, half = F.substring(text, 1, most + 1), F.substring(text, 1, most), most // 2
    sentence = F.regexp_extract(ahead, rf"(?s)^(.{{0,{most - 1}}}(?:[。！？!?\n]|(?<!\d)\.|\.(?!\d)))", 1)
    word = F.regexp_extract(head, r"(?s)^(.*)[ \t,，、]", 1)
    bare = F.when(sentence.endswith("\n"), F.substring(sentence, F.lit(1), F.char_length(sentence) - 1)).otherwise(sentence)
    return F.when(F.char_length(text) <= most, text).when((sentence != "") & (F.char_length(bare) >= half), bare).when(F.char_length(word) >= half, word).otherwise(head)


def fold_punctuation(text: Column) -> Column:
    """Full-width punctuation as half-width (fixed values)."""
    return F.translate(text, "，。：；！？（）【】", ",.:;!?()[]")


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^---\r?\n.*?\r?\n---\r?\n", "")


def wiki_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)"), F.lit(1))


def tagged_block(text: Column, tag: str) -> Column:
    return F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)


def thought(text: Column) -> Column:
    """The first closed <thought> block as struct (found, text, segments, nested, unclosed); one that is never closed is not found."""
    block = r"(?s)<thought>(.*?)</thought>"
    n = F.coalesce(F.regexp_count(text, F.lit(block)), F.lit(0))
    inner = F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), block, 1), r"(?U)^\s+|\s+$", "")
    return F.struct((n > 0).alias("found"), inner.alias("text"), n.alias("segments"), inner.contains("<thought>").alias("nested"), ((n == 0) & F.coalesce(text.contains("<thought>"), F.lit(False))).alias("unclosed"))


def numbered_sections(text: Column, names: tuple) -> Column:
    """A map from names to the texts after the lines numbered 1, 2, ...: to the next numbered line, the last of equal numbers; other numbers, blank texts and what comes first are left out."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"\r?\n(?=[ \t]*\d+[.、．])")
    number = lambda p: F.regexp_extract(p, r"^[ \t]*(\d{1,9})[.、．]", 1).cast("int")
    body = lambda p: F.regexp_replace(F.regexp_replace(p, r"^[ \t]*\d+[.、．]", ""), r"(?U)^\s+|\s+$", "")
    rows = F.filter(F.transform(F.slice(parts, 2, 1_000_000), lambda p: F.struct(number(p).alias("i"), body(p).alias("t"))), lambda x: x["i"].between(1, len(names)) & (x["t"] != ""))
    last = lambda i: F.element_at(F.filter(rows, lambda x: x["i"] == i), -1)["t"]
    have = F.filter(F.array(*[F.lit(i + 1) for i in range(len(names))]), lambda i: F.exists(rows, lambda x: x["i"] == i))
    return F.map_from_arrays(F.transform(have, lambda i: F.element_at(F.array(*[F.lit(n) for n in names]), i)), F.transform(have, last))


def limits(text: Column) -> Column:
    """'task:20000, plan:80000' as a map of whole numbers; parts that are not such are left out."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda p: p.rlike(r"^\s*[^:]+:\s*\d+\s*$"))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.lower(F.trim(F.split_part(p, F.lit(":"), F.lit(1)))), F.trim(F.split_part(p, F.lit(":"), F.lit(2))).cast("bigint"))))
