"""Token counts: batch encoding inside Arrow functions that return lengths only.

Texts are cut into batches of about equal bytes, and long texts are first split at boundaries where the tokenizer
certainly starts a new piece: before a single space between two visible ASCII characters, or between an ASCII letter
and a digit. A byte-level pre-tokenizer never joins across these, so the counts of the parts add up exactly.
Vocabularies with another pre-tokenizer or with added tokens that hold such a boundary get whole texts.

Such a vocabulary also cuts texts into parts of about a word (`WORDS`): before a single space between two visible characters and
between a letter and ASCII punctuation. Each distinct part is encoded once; a task keeps the lengths of up to `KNOWN_PARTS`
short ones, and the tasks after it in its worker have them too. A text that holds an added token goes without these cuts.

Nulls: a null text counts as empty and has 0 bytes and 0 tokens. Every row gives one row, repeated rows too.
"""

import json
import os
import re
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from tracklens.llm.common import field_of, packed, table, text_of

BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 15
TOKEN_LIMIT = 1024
KNOWN_PARTS = 1 << 19
KNOWN_CHARS = 32
ENCODED_PARTS = 1 << 12
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"  # an apostrophe may start a piece that goes on with letters
_CUT = rf"(?<=[!-~{_LETTER}])(?= [!-~{_LETTER}])|(?<=[{_LETTER}])(?=[{_MARK}'])|(?<=[{_MARK}])(?=[{_LETTER}])|\Z"
WORDS = re.compile(rf" ?[{_LETTER}]++(?=[{_MARK}']| [!-~{_LETTER}]|\Z)| ?[{_MARK}]++(?=[{_LETTER}]| [!-~{_LETTER}]|\Z)|(?s:.)+?(?:{_CUT})")
BOUNDARY = re.compile(r"(?<=[!-~])(?= [!-~])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def can_split(model: dict) -> bool:
    """True for a byte-level vocabulary whose added tokens hold no split boundary."""
    pre = model.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("normalizer")
    return bool(plain) and not any(BOUNDARY.search(t["content"]) or t.get("lstrip") or t.get("rstrip") for t in model.get("added_tokens") or [])


def pieces(text: str, size: int):
    """Parts of at least `size` characters that end at a safe boundary; joined they give the text."""
    start = 0
    while len(text) - start > size:
        found = BOUNDARY.search(text, start + max(1, size))
        if found is None:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:]


def batches_by_bytes(parts: list[tuple[int, str]], size: int):
    """Lists of (row, part) of about `size` bytes each; a larger part is a batch of its own."""
    batch, used = [], 0
    for row, part in parts:
        weight = len(part.encode("utf-8", "surrogatepass"))
        if batch and used + weight > size:
            yield batch
            batch, used = [], 0
        batch.append((row, part))
        used += weight
    if batch:
        yield batch


class PartCounts:
    """Token counts of texts as sums over their parts at `WORDS`; `encode` gives the counts of a list of texts."""

    def __init__(self, encode, added: list[str]):
        self.encode, self.added, self.known = encode, added, {}

    def whole(self, text: str) -> int:
        return sum(sum(self.encode([piece])) for piece in pieces(text, PIECE_CHARS))

    def learn(self, parts: list[str]) -> None:
        for at in range(0, len(parts), ENCODED_PARTS):
            some = parts[at:at + ENCODED_PARTS]
            self.known.update(zip(some, self.encode(some)))

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [None if any(token in text for token in self.added) else WORDS.findall(text) for text in texts]
        parts = set().union(*filter(None, cut))
        if len(self.known) + len(parts) > KNOWN_PARTS:
            self.known = {}
        missing = parts.difference(self.known)
        long = [part for part in missing if len(part) > KNOWN_CHARS]
        self.learn([part for part in missing if len(part) <= KNOWN_CHARS])
        self.known.update((part, self.whole(part)) for part in long)
        length = self.known.__getitem__
        counts = [self.whole(text) if words is None else sum(map(length, words)) for text, words in zip(texts, cut)]
        for part in long:
            del self.known[part]
        return counts


def _encoder(kind: str, content: bytes):
    """A function from texts to their token counts."""
    if kind == "json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content.decode("utf-8"))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=content)
    return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]


@lru_cache(maxsize=1)
def _counter(kind: str, content: bytes):
    """The encoder of a vocabulary, by parts where that is exact; a worker makes it once."""
    model = json.loads(content) if kind == "json" else {}
    if kind == "json" and can_split(model):
        return PartCounts(_encoder(kind, content), [token["content"] for token in model.get("added_tokens") or []])
    return _encoder(kind, content)


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. `vocabulary` is a .json or .model file on the driver.

    The file (a vocabulary, a few MB whatever the corpus) is sent to the workers with the function.
    """
    import pyarrow as pa

    with open(vocabulary, "rb") as file:
        content = file.read()
    kind = "json" if vocabulary.endswith(".json") else "model"

    def count(batches):
        encode = _counter(kind, content)
        for batch in batches:
            texts = batch.column("text_").to_pylist()
            parts = [(row, whole) for row, whole in enumerate(texts) if whole]
            counts = [0] * len(texts)
            for group in batches_by_bytes(parts, BATCH_BYTES):
                for (row, _), n in zip(group, encode([part for _, part in group])):
                    counts[row] += n
            yield pa.RecordBatch.from_arrays([batch.column("id_"), batch.column("bytes_"), pa.array(counts, pa.int64())], names=["id_", "bytes_", "tokens_"])

    rows = packed(docs).select(field_of(doc_id).alias("id_"), F.octet_length(text_of(text)).cast("long").alias("bytes_"), text_of(text).alias("text_"))
    kind_of_id = rows.schema["id_"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id_ {kind_of_id}, bytes_ long, tokens_ long")
    return counted.select(
        F.col("id_").alias("doc_id"), F.col("bytes_").alias("n_bytes"), F.col("tokens_").alias("n_tokens"), (F.col("tokens_") > limit).alias("over_limit")
    )


def op8_token_counts(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
