"""Tables of the registered queries: the corpus, and small tables joined to it.

The texts of the corpus are invented syllables, so English words are rare in them. The small
tables here therefore use words that do occur, and a few inline rows add the shapes of private
data that the corpus lacks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.data.tables import example_table, small_table
from corpuslens.operators.longform import to_long
from corpuslens.plans.session import spread
from corpuslens.sources.conversations import conversation_pairs

KEYS = ["row_id"]
FIELDS = ["prompt", "response", "document", "inline"]

WEIGHTS = {
    "that": 1.5, "with": 0.8, "this": 2.1, "que": 1.2, "und": 0.6, "from": -0.9, "was": -1.4,
    "der": -0.7, "les": -1.1, "trash": -1.8, "idiot": -2.3, "clown": -1.0, "scum": -2.4,
    "worthless": -1.9, "moron": -2.3, "pathetic": -2.6, "loser": -2.4, "stupid": -2.4,
    "disgusting": -2.4,
}
BOOSTERS = {"the": 0.293, "en": 0.293, "die": 0.1, "is": -0.293, "un": -0.2}
NEGATIONS = ["of", "nicht", "la", "er"]

TOPICS = {
    "law": [("license", 4.0), ("licensed", 3.0), ("general", 2.0), ("the", 1.0)],
    "finance": [("of", 1.5), ("und", 1.0), ("stock", 4.0)],
    "medical": [("in", 2.0), ("zu", 1.0), ("des", 1.0)],
    "education": [("to", 1.5), ("la", 1.0), ("es", 2.0)],
    "politics": [("and", 1.5), ("public", 4.0), ("der", 1.0)],
    "support": [("version", 4.0), ("a", 1.5), ("de", 1.0)],
}
CUSTOM_TOPICS = {
    "insults": [("idiot", 2.0), ("trash", 2.0), ("scum", 2.0), ("stupid", 2.0), ("loser", 2.0)],
    "licences": [("license", 1.0), ("apache", 1.0), ("gnu", 1.0), ("cc", 1.0)],
    "articles": [("the", 0.25), ("der", 0.25), ("le", 0.25), ("el", 0.25)],
}

CUSTOM_PATTERNS = [
    ("secret", r"""(?i)(token|key|secret)\s*=\s*["'][0-9a-f]{16,}"""),
    ("licence", r"(?i)licen[cs]ed? under|all rights reserved"),
    ("licence", r"(?i)\bversion [0-9]"),
    ("repeated mark", r"[!?]{2,}"),
]

GAZETTEER = {
    "ORGANIZATION": ["apache", "GNU General Public"],
    "LOCATION": ["the of", "von"],
    "PERSON": ["idiot", "de la"],
}

SELECTED = ["CREDIT_CARD", "EMAIL_ADDRESS", "IP_ADDRESS", "AU_TFN", "EMAIL_ADDRESS"]

# A hit and a near miss for each shape and check digit.
INLINE = [
    "SSN 123-45-6789 here", "SSN 666-45-6789 here", "ssn 125-55-5555 no", "ssn 123 45 6789",
    "ssn 123-45 6789 no", "ssn 123-00-6789 no", "ssn 123456789", "ssn 923-45-6789 no",
    "card 4111 1111 1111 1111 ok", "card 4111 1111 1111 1112 bad", "card 378282246310005",
    "call (974) 555-3436 now", "call 974 5553436 now", "call +49 170 1234567", "call +4917012345678",
    "at 12 N 5 Main Street", "at 12 Main Stret", "at 221 Baker Street", "at Baker Street",
    "mail ana.o'neil+x@ex-ample.com", "mail ana@example", "cpf 123.456.789-09", "cpf 123.456.789-0",
    "cnpj 12.345.678/0001-95", "cnpj 12.345.678/001-95", "tel (11) 91234-5678", "tel 91234-567",
    "cep 01310-100", "cep 01310-10", "Rua das Flores, 123", "Av. Paulista, 1578", "Praça da Sé",
    "rua das flores", "card 4111111111111111", "card 41111111111111112",
    "driver license D1234567", "document D1234567", "abn 51 824 753 556", "abn 51 824 753 557",
    "acn 004 085 616", "acn 004 085 617", "tfn 123 456 782", "tfn 123 456 783", "pan ABCDE1234F",
    "pan ABCD1234F", "plate KA 01 AB 1234", "plate KA AB 1234", "on 2024-05-06T07:08:09 sharp",
    "on 6/5/2024 at 7:08", "on 2024-5", "med BA3456781", "med BB1388568", "see https://ex.org/a?b=1 now",
    "see www.ex.org", "see ex.org", "btc 1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "btc 2Boat",
    "btc bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "nhs 943 476 5919", "nhs 943 476 5918",
    "itin 912-70-1234", "itin 912-69-1234", "bank account 12345678", "number 12345678",
    "iban GB82WEST12345698765432", "iban GB82WEST12345698765431", "iban DE89370400440532013000",
    "ip 192.168.0.254", "ip 192.168.0.256", "ip 2001:0db8:85a3:0000:0000:8a2e:0370:7334", "ip 2001:0db8::1",
    "no digits at all", "", "4",
    "card 3056 930902 5904", "card 3056 930902 5905", "card 6304 0000 0000 0000 000", "card 6304 0000 0000 0000 001",
    "iban GB82 WEST 1234 5698 7654 32", "iban GB82 WEST 1234 5698 7654 33", "iban NO93 8601 1117 947",
    "card 4111 1111 1111 1111 123 cvv", "iban ES91 2100 0418 4502 0005 1332 PAID today",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, instruction, prompt, response) of the answered user turns."""
    found = conversation_pairs(table(spark, sf_dir, "conversations"))
    row_id = F.col("conv_id") * 1_000_000 + F.col("turn")
    return found.select(row_id.alias("row_id"), "instruction", "prompt", "response")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in long form."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return spread(texts, "row_id").select("row_id", F.lit("document").alias("field"), "text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts, responses and documents in long form."""
    return to_long(pairs(spark, sf_dir), KEYS).unionByName(documents(spark, sf_dir))


def inline_rows(spark: SparkSession) -> DataFrame:
    rows = [(i, "inline", text) for i, text in enumerate(INLINE)]
    return small_table(spark, ["row_id", "field", "text"], rows)


def corpus_with_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).unionByName(inline_rows(spark))


def topic_rows(topics: dict) -> list[tuple]:
    return [(topic, token, weight) for topic, words in topics.items() for token, weight in words]


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipped examples, and per group passages that the corpus does contain."""
    passages = table(spark, sf_dir, "benchmark").select(
        F.lit("injection").alias("group"), F.col("item_id").alias("example_id"), "text"
    )
    # The exchange after a system turn stands in for known attacks and refusals.
    group = F.when((F.col("role") == "user") & (F.col("turn") == 1), "jailbreak").when(
        (F.col("role") == "assistant") & (F.col("turn") == 2), "refusal"
    )
    openings = (
        table(spark, sf_dir, "conversations")
        .select(group.alias("group"), F.col("conv_id").alias("example_id"), "text")
        .where(F.col("group").isNotNull())
    )
    shipped = example_table(spark).withColumn("example_id", -1 - F.col("example_id"))
    return shipped.unionByName(passages).unionByName(openings)


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label as the examples of one theme."""
    means = (
        table(spark, sf_dir, "embeddings")
        .select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("xs"))
    )
    return means.select(
        F.lit("theme").alias("group"),
        F.col("label").alias("example_id"),
        F.transform("xs", lambda e: e["x"]).alias("embedding"),
    )
