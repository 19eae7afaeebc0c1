"""A small controlled vocabulary as a table, and what texts name or deny of it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinequarry.functions.matcher import Offsets, denial_spans, families, is_wide, matcher, terms, wide_grams, words
from cinequarry.functions.text import pieces
from cinequarry.plans.scratch import settle

#: Texts that become Python objects at once.
READ_ROWS = 256

# Kind, concept and the words that name it.
VOCABULARY = {
    "object": {
        "car": ["汽车", "轿车", "车", "车流", "交通", "car", "cars", "vehicle", "vehicles", "sedan", "truck", "卡车", "traffic"],
        "umbrella": ["伞", "雨伞", "umbrella", "umbrellas"],
        "person": ["人", "行人", "人们", "person", "people", "human", "pedestrian"],
        "dog": ["狗", "dog", "dogs"],
        "cat": ["猫", "cat", "cats"],
        "boat": ["船", "boat", "boats", "ship"],
        "laptop": ["笔记本", "laptop", "computer"],
        "train": ["火车", "列车", "train", "trains"],
        "bridge": ["桥", "bridge", "bridges"],
        "bicycle": ["自行车", "单车", "bicycle", "bike", "bikes"],
        "flower": ["花", "flower", "flowers", "tulip", "tulips", "郁金香"],
        "cup": ["杯", "杯子", "cup", "coffee cup"],
        "table": ["桌", "桌子", "table", "desk"],
        "ocean": ["海", "大海", "ocean", "sea"],
        "sun": ["太阳", "sun"],
    },
    "action": {
        "walking": ["走", "行走", "步行", "漫步", "walk", "walking", "stroll", "strolling"],
        "running": ["跑", "奔跑", "run", "running"],
        "driving": ["开", "驾驶", "drive", "driving"],
        "eating": ["吃", "eating", "eat"],
        "drinking": ["喝", "drink", "drinking"],
        "sitting": ["坐", "sit", "sitting"],
    },
    "scene": {
        "street": ["街", "街道", "路", "马路", "street", "streets", "road", "alley", "avenue"],
        "city": ["城市", "城", "city", "cities", "urban", "downtown"],
        "beach": ["海边", "沙滩", "海滩", "beach", "beaches"],
        "park": ["公园", "park", "parks"],
        "market": ["市场", "集市", "market", "markets"],
        "kitchen": ["厨房", "kitchen"],
        "cafe": ["咖啡厅", "咖啡馆", "cafe", "coffee shop"],
        "office": ["办公室", "office"],
        "mountain": ["山", "山间", "mountain", "mountains"],
        "river": ["河", "河流", "river"],
        "station": ["车站", "火车站", "station", "platform", "站台"],
        "school": ["学校", "校园", "school", "schoolyard"],
        "library": ["图书馆", "library"],
        "restaurant": ["餐厅", "饭馆", "restaurant", "dining"],
        "stadium": ["体育场", "场馆", "stadium", "arena"],
        "factory": ["工厂", "factory"],
        "garden": ["花园", "园", "garden", "gardens"],
    },
    "weather": {
        "rain": ["雨", "下雨", "雨天", "rain", "rainy", "raining"],
        "snow": ["雪", "下雪", "snow", "snowy", "snowing"],
        "fog": ["雾", "fog", "foggy", "mist"],
        "wind": ["风", "wind", "windy"],
        "sunny": ["晴", "晴天", "sunny", "clear"],
    },
    "time": {
        "night": ["夜晚", "夜里", "晚上", "夜", "晚", "night", "nighttime", "evening"],
        "day": ["白天", "日", "day", "daytime"],
        "dawn": ["黎明", "拂晓", "清晨", "dawn"],
        "dusk": ["黄昏", "傍晚", "dusk"],
        "morning": ["早晨", "早上", "morning"],
    },
    "mood": {
        "lonely": ["孤独", "lonely"],
        "depressing": ["压抑", "阴郁", "depressing", "oppressive"],
        "cinematic": ["电影感", "氛围", "cinematic", "moody"],
    },
    "camera": {
        "aerial": ["航拍", "俯瞰", "aerial", "bird's eye"],
    },
    "shot_size": {
        "close_up": ["特写", "closeup", "close-up", "close up"],
        "wide": ["全景", "广角", "wide", "establishing"],
        "medium": ["中景", "medium", "medium shot"],
    },
}
NEGATIONS = ["没有", "无人", "无", "不见", "no", "without"]
ABSENCE = ["空", "empty", "abandoned", "unoccupied"]  # describe a thing, and deny nothing
CLAUSE_ENDS = "的在于是了也就都还很更但而则且或与和及又再，。、；：！？…"
CJK_STOPWORDS = ["地方", "场景", "画面", "镜头", "素材", "东西", "内容", "片段"]
#: Order in which a query's needs are listed.
KINDS = ("object", "action", "scene", "weather", "time", "mood", "speech", "camera", "shot_size", "tag", "metadata")
MODES = ("auto", "fact", "speech", "semantic", "similar", "creative")
CREATIVE = ("给我找", "帮我找", "找点", "找几个", "来几个", "来点", "创意", "creative")
SPEECH_MARKERS = ("说过", "说了", "说道", "提到", "说")
QUOTES = (("「", "」"), ("“", "”"), ('"', '"'), ("'", "'"))
SHOT_ID = r"(?i)(shot_[a-z0-9]{6,})"


@cache
def _concepts() -> dict[str, list[tuple[str, str]]]:
    """The concepts of each word."""
    out: dict[str, list[tuple[str, str]]] = {}
    for kind, own in VOCABULARY.items():
        for concept, listed in own.items():
            for w in listed:
                out.setdefault(w, []).append((kind, concept))
    return out


def _reads(text: str) -> tuple[list[tuple[str, int]], list[tuple[int, int]]]:
    """(every vocabulary and negation word of a lower-case text with its character, what the text denies in bytes): one pass."""
    found = list(matcher((*_concepts(), *NEGATIONS)).places(text))
    found.sort(key=lambda x: x[1])
    return found, denial_spans(text, found, NEGATIONS, CLAUSE_ENDS)


def _passed(texts: DataFrame, key: str, columns: str, rows_of: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """key and ``columns``: what ``rows_of`` gives of each lower-case text, in Arrow batches."""
    names = [c.split()[0] for c in columns.split(", ")]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in columns.split(", ")]
        for batch in pieces(batches, READ_ROWS):
            owner, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = list(rows_of(text))
                owner += [i] * len(own)
                rows += own
            values = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owner, pa.int64())), *values], names=[key, *names])

    return texts.select(key, "text").mapInArrow(read, f"`{key}` {texts.schema[key].dataType.simpleString()}, {columns}")


def denials(texts: DataFrame, key: str) -> DataFrame:
    """key, start, end: byte ranges in which a lower-case text denies what it names.

    A wide word denies up to the end of its clause at every occurrence, a
    plain one itself and two bytes more, at its first. Only texts with such a
    word reach the Python step.
    """
    return _passed(texts.where(F.col("text").rlike("|".join(NEGATIONS))), key, "start long, end long", lambda text: _reads(text)[1])


def _named(text: str) -> Iterator[tuple[str, str, int, bool]]:
    found, denied = _reads(text)
    byte = Offsets(text)
    for (kind, concept), at in families(found, _concepts()).items():
        position = byte(at)
        yield kind, concept, position, any(s <= position < e for s, e in denied)


def named(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, kind, concept, position, denied: the vocabulary that each text names, at its earliest place.

    One automaton reads each text once; repeated keys of one concept keep the
    earliest place, and are denied if any is.
    """
    source = texts.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    rows = _passed(source, key, "kind string, concept string, position long, denied boolean", _named)
    return rows.groupBy(key, "kind", "concept").agg(F.min("position").alias("position"), F.bool_or("denied").alias("denied"))


def own_terms(text: str) -> Iterator[tuple[str, int]]:
    """(term, character) of the terms of a lower-case text that the vocabulary doesn't know.

    A plain term has three letters or more; one of a script without blanks has
    two or three, is no stopword and holds no vocabulary or negation word.
    """
    names = _concepts()
    for term, at in terms(text):
        if is_wide(term):
            if 2 <= len(term) <= 3 and term not in CJK_STOPWORDS and not any(w in term for w in (*names, *NEGATIONS, *ABSENCE)):
                yield term, at
        elif len(term) >= 3 and term not in names and term not in NEGATIONS and term not in ABSENCE:
            yield term, at


def _unclaimed(text: str) -> Iterator[tuple[str, int, bool]]:
    denied = _reads(text)[1]
    byte = Offsets(text)
    for term, at in own_terms(text):
        position = byte(text.index(term))
        yield term, position, any(s <= position < e for s, e in denied)


def unclaimed(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, value, position, denied: terms of a text that the vocabulary doesn't know (own_terms()), as objects of their own."""
    source = texts.select(key, F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))).alias("text"))
    return _passed(source, key, "value string, position long, denied boolean", _unclaimed)


def mentioned(text: str) -> set[str]:
    """All that a field's value says: concepts, terms of its own, plain words, and the short pieces of wide terms."""
    text = text.lower()
    found, _ = _reads(text)
    return {concept for _, concept in families(found, _concepts())} | {t for t, _ in own_terms(text)} | {*words(text)} | wide_grams(text)


def described(text: str) -> list[tuple[str, str, bool]]:
    """("description", value, denied) of all that a description says or denies."""
    text = text.lower()
    found, denied = _reads(text)
    byte = Offsets(text)
    within = lambda at: any(s <= byte(at) < e for s, e in denied)
    out = {concept: within(at) for (_, concept), at in families(found, _concepts()).items()}
    for word, at in words(text).items():
        out.setdefault(word, len(word) >= 3 and within(at))
    for piece in {t for t, _ in own_terms(text)} | wide_grams(text):
        out.setdefault(piece, False)
    return [("description", value, no) for value, no in out.items()]


def speech_phrase(text: Column) -> Column:
    """What a query quotes: between quotation marks, else after the last speech marker; null if nothing.

    The first kind of quotation marks that a query has decides, even with nothing between them.
    """
    quoted = F.coalesce(*[F.when(F.rlike(text, F.lit(f"{a}[^{b}]*{b}")), F.trim(F.regexp_extract(text, f"{a}([^{b}]*){b}", 1))) for a, b in QUOTES])
    marked = [F.nullif(F.trim(F.element_at(F.split(F.when(F.contains(text, F.lit(m)), text), m), -1)), F.lit("")) for m in SPEECH_MARKERS]
    return F.when(quoted.isNotNull(), F.nullif(quoted, F.lit(""))).otherwise(F.coalesce(*marked))


def compile_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, text, phrase, intent) and (query_id, need, kind, value, position) of queries (query_id, text).

    need is must, should or must_not: named objects and unknown terms must be
    there, other kinds should, denied ones must not; a query that only should
    have things must have them. A spoken phrase and a shot id are musts. A
    column mode of the queries, one of MODES or empty, overrides the intent;
    any other is an error.
    """
    has_mode = "mode" in queries.columns
    phrases = settle(queries.select("query_id", "text", *(["mode"] if has_mode else []), speech_phrase(F.col("text")).alias("phrase"), F.lower(F.nullif(F.regexp_extract("text", SHOT_ID, 1), F.lit(""))).alias("shot")))
    rest = phrases.withColumn("rest", F.when(F.col("phrase").isNull(), F.col("text")).otherwise(F.expr("replace(text, phrase, ' ')")))
    rest = rest.select("query_id", F.col("rest").alias("text"))
    unknown = unclaimed(rest, "query_id").select("query_id", F.lit("object").alias("kind"), F.col("value").alias("concept"), "position", "denied")
    found = settle(named(rest, "query_id").unionByName(unknown))  # it is read four times below
    need = F.when(F.col("denied"), "must_not").when(F.col("kind") == "object", "must").otherwise("should")
    rows = found.select("query_id", need.alias("need"), "kind", F.col("concept").alias("value"), "position")
    spoken = phrases.where("phrase IS NOT NULL").select("query_id", F.lit("must").alias("need"), F.lit("speech").alias("kind"), F.col("phrase").alias("value"), F.lit(-1).alias("position"))
    shots = phrases.where("shot IS NOT NULL").select("query_id", F.lit("must").alias("need"), F.lit("metadata").alias("kind"), F.col("shot").alias("value"), F.lit(-1).alias("position"))
    rows = rows.unionByName(spoken).unionByName(shots)
    musts = rows.where("need = 'must'").select("query_id").distinct().withColumn("has_must", F.lit(True))
    rows = rows.join(musts, "query_id", "left").withColumn("need", F.when((F.col("need") == "should") & F.col("has_must").isNull(), "must").otherwise(F.col("need"))).drop("has_must")
    seen = rows.groupBy("query_id").agg(F.bool_or(F.col("need") == "must_not").alias("denies"), F.bool_or((F.col("need") != "must_not") & (F.col("kind") == "object")).alias("objects"), F.bool_or((F.col("need") != "must_not") & (F.col("kind") == "mood")).alias("moods"), F.bool_or((F.col("need") != "must_not") & F.col("kind").isin("scene", "time", "weather")).alias("settings"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    creative = F.lower("text").rlike("|".join(CREATIVE))
    intent = F.when(F.trim("text") == "", "auto").when(F.col("phrase").isNotNull(), "speech").when(F.col("shot").isNotNull(), "similar").when(flag("denies"), "fact").when(creative, "creative").when((flag("moods") | flag("settings")) & ~flag("objects"), "semantic").otherwise("fact")
    if has_mode:
        mode = F.coalesce("mode", F.lit(""))
        known = F.when(mode.isin("", "auto"), intent).when(mode.isin(*MODES), mode)
        intent = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown mode "), mode)).cast("string"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    order = Window.partitionBy("query_id", "need").orderBy(rank, "position", "value")
    rows = rows.withColumn("place", F.row_number().over(order).cast("long"))
    return phrases.join(seen, "query_id", "left").select("query_id", "text", "phrase", intent.alias("intent")), rows
