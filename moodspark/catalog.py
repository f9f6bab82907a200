"""Label catalogs: every label space as data, never as hard-coded ids in code.

``catalog_df`` returns ``(space, name, id)`` and ``edge_df`` returns
``(src_space, src_name, dst_space, dst_id)``; both are tiny, fixed-size tables
(tens of rows), so broadcasting them is safe at any data scale.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Fixed values (must equal the source project's label spaces, in its order).
# ---------------------------------------------------------------------------

# Chatbot CSV labels: 0 everyday, 1 parting/negative, 2 love/positive.
RAW3 = ["일상다반사", "이별(부정)", "사랑(긍정)"]

# Six-class classifier ids.
SIX_BERT = ["상처", "불안", "분노", "슬픔", "기쁨", "당황"]

# Six-class LM ids (first appearance in the training sheet), plus everyday.
SIX_FIRST = ["분노", "기쁨", "불안", "당황", "슬픔", "상처", "기타"]

# Fifteen-class classifier ids.
FIFTEEN_BERT = [
    "감사하는", "당황한", "분노한", "슬픈", "불안한", "기쁨", "외로운", "편안한",
    "스트레스 받는", "부끄러운", "실망한", "열등감을 느끼는", "후회되는", "자신하는", "회의적인",
]

# Fifteen-class LM ids (first appearance), plus everyday = 15.
FIFTEEN_FIRST = [
    "분노한", "편안한", "불안한", "당황한", "기쁨", "슬픈", "외로운", "부끄러운",
    "스트레스 받는", "실망한", "열등감을 느끼는", "회의적인", "후회되는", "자신하는", "감사하는", "기타",
]

# Fine-grained names collapsed into the fifteen-class ids (id -> names).
FINE_TO_FIFTEEN = {
    0: ["감사하는"],
    1: ["당황", "당혹스러운", "혼란스러운", "충격 받은"],
    2: ["분노", "노여워하는", "짜증내는", "구역질 나는"],
    3: ["슬픔", "배신당한", "비통한", "우울한", "눈물이 나는", "낙담한", "괴로워하는",
        "가난한, 불우한", "억울한", "좌절한"],
    4: ["불안", "걱정스러운", "마비된", "안달하는", "초조한", "취약한", "두려운"],
    5: ["기쁨", "신이 난", "흥분", "만족스러운"],
    6: ["외로운", "희생된", "버려진", "상처", "고립된"],
    7: ["편안한", "느긋", "안도"],
    8: ["스트레스 받는", "성가신", "환멸을 느끼는"],
    9: ["부끄러운"],
    10: ["실망한", "툴툴대는", "한심한"],
    11: ["열등감", "질투하는", "남의 시선을 의식하는"],
    12: ["후회되는", "죄책감의"],
    13: ["자신하는"],
    14: ["회의적인", "염세적인"],
}

# Fine-grained names dropped before the collapse.
FINE_DROPPED = ["조심스러운", "방어적인", "신뢰하는", "악의적인", "혐오스러운"]

# English utterance tags -> six-class and fifteen-class ids; "neutral" is dropped.
ENGLISH_TO_SIX = {"fear": 1, "angry": 2, "disgust": 2, "sadness": 3, "happiness": 4, "surprise": 5}
ENGLISH_TO_FIFTEEN = {"fear": 4, "angry": 2, "disgust": 2, "sadness": 3, "happiness": 5, "surprise": 1}
ENGLISH_DROPPED = ["neutral"]

# Chatbot CSV label -> six_first / fifteen-class ids, as the source maps them.
RAW3_TO_SIX_FIRST = {0: 6, 1: 4, 2: 1}
RAW3_TO_FIFTEEN = {0: 15, 1: 3, 2: 5}

# Six-class names with the subject particle, used in the result sentence.
SIX_BERT_WITH_PARTICLE = ["상처가", "불안이", "분노가", "슬픔이", "기쁨이", "당황이"]

# Result sentence around the predicted name (with particle).
RESULT_SENTENCE = ">> 입력하신 내용에서 %s 느껴집니다."

# Special tokens of the sequence encoders.
CLS, SEP, PAD_TOKEN, UNK_TOKEN = "[CLS]", "[SEP]", "[PAD]", "[UNK]"
Q_TOKEN, A_TOKEN, SENT_TOKEN, EOS_TOKEN, MASK_TOKEN, LM_PAD = "<usr>", "<sys>", "<unused1>", "</s>", "<unused0>", "<pad>"

# ---------------------------------------------------------------------------
# Fixture bindings (our own choices for the driver tables, not source values).
# ---------------------------------------------------------------------------

# events.event_type -> id for the strict/lenient lookups.
EVENT_TYPES = ["click", "view", "purchase", "signup", "error"]
EVENT_TYPES_PARTIAL = ["click", "view", "purchase"]

# documents.source (src0..src19) -> 15 classes: src0..src14 keep their number,
# src15..src17 collapse onto 0..2, src18 and src19 are dropped.
def fixture_source_edges() -> list[tuple[str, int]]:
    edges = [(f"src{i}", i) for i in range(15)]
    edges += [(f"src{15 + i}", i) for i in range(3)]
    return edges


FIXTURE_SOURCE_DROPPED = ["src18", "src19"]

# Lexicon scorer for the fixture: word -> emotion class 0..14.
FIXTURE_LEXICON = ["the", "of", "and", "in", "that", "de", "la", "le", "en", "les",
                   "der", "und", "sch", "ist", "el"]

def catalog_rows() -> list[tuple[str, str, int]]:
    rows: list[tuple[str, str, int]] = []
    for space, names in (("raw3", RAW3), ("six_bert", SIX_BERT), ("six_first", SIX_FIRST),
                         ("fifteen_bert", FIFTEEN_BERT), ("fifteen_first", FIFTEEN_FIRST),
                         ("six_particle", SIX_BERT_WITH_PARTICLE), ("event_type", EVENT_TYPES),
                         ("event_type_partial", EVENT_TYPES_PARTIAL)):
        rows += [(space, n, i) for i, n in enumerate(names)]
    for i, w in enumerate(FIXTURE_LEXICON):
        rows.append(("fixture_lexicon", w, i))
    return rows


def edge_rows() -> list[tuple[str, str, str, int]]:
    rows: list[tuple[str, str, str, int]] = []
    for dst, names in FINE_TO_FIFTEEN.items():
        rows += [("raw_fine", n, "fifteen_bert", dst) for n in names]
    rows += [("english", k, "six_bert", v) for k, v in ENGLISH_TO_SIX.items()]
    rows += [("english", k, "fifteen_bert", v) for k, v in ENGLISH_TO_FIFTEEN.items()]
    rows += [("raw3", str(k), "six_first", v) for k, v in RAW3_TO_SIX_FIRST.items()]
    rows += [("raw3", str(k), "fifteen_first", v) for k, v in RAW3_TO_FIFTEEN.items()]
    rows += [("fixture_source", n, "fifteen", i) for n, i in fixture_source_edges()]
    return rows


def dropped_names(space: str) -> list[str]:
    return {"raw_fine": FINE_DROPPED, "english": ENGLISH_DROPPED,
            "fixture_source": FIXTURE_SOURCE_DROPPED}.get(space, [])


def local_table(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """Rows as a table whose size Spark knows, so that its own broadcast threshold decides on joins with it."""
    arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(columns.values())]
    return spark.createDataFrame(pa.table(dict(zip(columns, arrays))))


def catalog_df(spark: SparkSession, space: str | None = None) -> DataFrame:
    df = local_table(spark, catalog_rows(), space=pa.string(), name=pa.string(), id=pa.int32())
    return df if space is None else df.where(df.space == space)


def edge_df(spark: SparkSession, src_space: str | None = None, dst_space: str | None = None) -> DataFrame:
    df = local_table(spark, edge_rows(), src_space=pa.string(), src_name=pa.string(), dst_space=pa.string(), dst_id=pa.int32())
    if src_space is not None:
        df = df.where(df.src_space == src_space)
    if dst_space is not None:
        df = df.where(df.dst_space == dst_space)
    return df


def names(space: str) -> list[str]:
    return [n for s, n, _ in sorted((r for r in catalog_rows() if r[0] == space), key=lambda r: r[2])]
