"""Processing of entries and artifacts with injected models: embedders, classifiers, analysers, entity extractors.

A model is a picklable Python callable that takes a list of texts and returns a list of results of the same length. It
runs where the rows are, in Arrow batches cut to the size that the model takes at once; results keep the rows' order. Tests
and registered queries inject deterministic models; a service's client is injected in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brainweave.functions import text
from brainweave.operators import chunking, graph, upsert
from brainweave.operators.memo import Memo

Model = Callable[[list[str]], list[Any]]

ENTITIES = "array<struct<entity_type:string,display_name:string,aliases:array<string>,salience:double>>"
CLASSES = (
    "clean_text string, summary string, language string, tags array<string>, primary_type string, primary_type_confidence double, "
    "suggested_actions array<struct<kind:string,reason:string,confidence:double>>"
)
ANALYSIS = "summary string, excerpt string, tags array<string>, language string"
#: Texts whose answers a task holds at once; a multiple of the sizes that models take by default.
ROWS = 1000
#: Link types that follow from entities, and are made anew by a relink.
ENTITY_LINKS = ("mentions_person", "relates_to_event", "mentions_entity", "relates_to_task", "echoes_artifact")


def _batched(model: Model, texts: list[str], size: int) -> list[Any]:
    out: list[Any] = []
    for i in range(0, len(texts), size):
        part = texts[i : i + size]
        got = model(part)
        if len(got) != len(part):
            raise ValueError(f"the model returned {len(got)} results for {len(part)} texts")
        out += got
    return out


def _portions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Batches of at most ``ROWS`` texts: what models say about them is held as Python objects."""
    for s in batches:
        for i in range(0, len(s), ROWS):
            yield s.iloc[i : i + ROWS]


def embed(df: DataFrame, column: str, model: Model, dim: int, into: str = "embedding", size: int = 100) -> DataFrame:
    """df with vectors of a text column, ``size`` texts at a time; null texts have none, other sizes than ``dim`` are an error."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in _portions(batches):
            some = [i for i, t in enumerate(s) if t is not None]
            out: list = [None] * len(s)
            for i, v in zip(some, _batched(model, [s.iloc[i] for i in some], size), strict=True):
                if len(v) != dim:
                    raise ValueError(f"a vector of {len(v)} numbers; {dim} were expected")
                out[i] = [float(x) for x in v]
            yield pd.Series(out, dtype=object)

    return df.withColumn(into, vectors(F.col(column)))


def ask(df: DataFrame, column, model: Model, schema: str, into: str, size: int = 20) -> DataFrame:
    """df with a struct column of what a model says about a text: dicts with the schema's fields. Null texts have null."""

    @F.pandas_udf(schema)
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _fields(schema)]
        for s in _portions(batches):
            some = [i for i, t in enumerate(s) if t is not None]
            got = dict(zip(some, _batched(model, [s.iloc[i] for i in some], size), strict=True))
            yield pd.DataFrame({n: pd.Series([got.get(i, {}).get(n) for i in range(len(s))], dtype=object) for n in names})

    return df.withColumn(into, answers(column))


def _fields(schema: str) -> list[str]:
    """The top-level fields of a schema in words."""
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def entities_of(df: DataFrame, column: str, model: Model, into: str = "entities", most: int = 10_000) -> DataFrame:
    """df with the entities of a text; the model is shown its first ``most`` characters, as the archive does."""
    asked = ask(df, F.substring(F.col(column), 1, most), model, f"entities {ENTITIES}", "_e")
    return asked.withColumn(into, F.col("_e.entities")).drop("_e")


def process_entries(entries: DataFrame, classify: Model, embedder: Model, dim: int, memo: Memo | None = None) -> DataFrame:
    """Pending entries (entry_id, full_text, status) with the classifier's fields, a vector, and status processed.

    Feedback isn't shown to the classifier: it is archived as it is. With a memo no text is sent twice, and entries whose texts failed are
    left out: they are ``memo.failed(..., "classify")`` and ``"embed"``.
    """
    pending = entries.filter("status = 'pending'")
    fb = text.is_feedback(F.col("full_text"))
    shown = F.when(~fb, F.col("full_text"))
    if memo is None:
        asked = ask(pending, shown, classify, CLASSES, "_c")
    else:
        asked = memo.ask(pending, shown, classify, CLASSES, "_c", "classify").filter(fb | F.col("_c").isNotNull())
    fixed = {"clean_text": F.col("full_text"), "language": F.lit("en"), "primary_type": F.lit("archive_only"), "primary_type_confidence": F.lit(1.0)}
    empty = F.array().cast("array<struct<kind:string,reason:string,confidence:double>>")
    fixed |= {"suggested_actions": empty, "tags": text.first_line_hashtags(F.col("full_text"))}
    values = {n: F.when(fb, fixed.get(n)).otherwise(F.col(f"_c.{n}")) if n in fixed else F.col(f"_c.{n}") for n in (f.split()[0] for f in _fields(CLASSES))}
    done = asked.withColumns(values).drop("_c").withColumns({"status": F.lit("processed"), "last_error": F.lit(None).cast("string")})
    if memo is None:
        return embed(done, "clean_text", embedder, dim)
    return memo.embed(done, "clean_text", embedder, dim, "embedding", "embed").filter("embedding IS NOT NULL")


def process_artifacts(artifacts: DataFrame, analyse: Model, embedder: Model, extract: Model, dim: int, most: int = 12_000) -> dict[str, DataFrame]:
    """The archive's stages over artifacts (artifact, title, raw_source, summary, tags): artifacts, chunks and mentions.

    The source's own summary and tags win over the model's.
    """
    clean = artifacts.withColumn("clean_text", text.normalize_markdown(F.col("raw_source")))
    shown = F.concat_ws("\n\n", "title", F.substring("clean_text", 1, most))
    asked = ask(clean, shown, analyse, ANALYSIS, "_a")
    own_tags = F.when(F.size("tags") > 0, F.col("tags"))
    done = asked.withColumns(
        {
            "summary": F.coalesce("summary", "_a.summary"), "tags": F.coalesce(own_tags, F.col("_a.tags")), "excerpt": F.col("_a.excerpt"), "language": F.col("_a.language"),
            "word_count": text.word_count(F.col("clean_text")), "processing_status": F.lit("processed"), "last_error": F.lit(None).cast("string"),
        }
    ).drop("_a")
    parts = chunking.chunk_documents(clean, "artifact", "clean_text")
    said = entities_of(clean.select("artifact", *[c for c in ("user_id",) if c in clean.columns], "clean_text"), "clean_text", extract)
    return {
        "artifacts": embed(done, "summary", embedder, dim),
        "chunks": embed(parts, "chunk_text", embedder, dim),
        "mentions": mention_rows(said, "artifact"),
    }


def mention_rows(said: DataFrame, key: str) -> DataFrame:
    """(key, user_id, entity_no, entity, entity_type, display_name, aliases, salience): a row per entity, named by user, type and lower-cased name.

    Without a column user_id all are one user's.
    """
    user = [c for c in ("user_id",) if c in said.columns]
    rows = said.select(key, *user, F.posexplode("entities").alias("entity_no", "e"))
    entity = F.concat_ws(":", *user, "e.entity_type", F.lower(text.strip(F.col("e.display_name"))))
    return rows.select(key, *user, "entity_no", entity.alias("entity"), "e.*")


def replace_mentions(current: DataFrame, done: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions after a run over the artifacts ``done``: all of theirs go, also of those without any now, and the new ones come in.

    A mention has no place in the text, so no two are the same one: an entity that an artifact names twice has two rows.
    """
    return upsert.clear_children(current, done, "artifact").unionByName(mentions.select(*current.columns))


def upsert_entities(current: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities by user, type and lower-cased trimmed name; the last mention's display name and aliases overwrite.

    Where current has no column user_id, all are one user's.
    """
    name = F.lower(text.strip(F.col("display_name")))
    keys = [*(c for c in ("user_id",) if c in current.columns), "entity_type", "normalized_name"]
    new = mentions.withColumn("normalized_name", name).select(*keys, "display_name", "aliases", "seq")
    last = upsert.last_per_key(new, keys, ["seq"])
    return upsert.upsert(current, last, keys, ["display_name", "aliases", "seq"])


def cross_links(mentions: DataFrame, least: int = 2) -> DataFrame:
    """Links between artifacts that share two entities or more; without confidence."""
    pairs = graph.shared_entity_pairs(mentions.select("artifact", "entity", "salience"), least)
    return pairs.select(
        F.col("artifact").alias("source_id"), F.lit("artifact").alias("target_type"), F.col("other").alias("target_id"),
        F.lit("shares_entities").alias("link_type"), F.lit(None).cast("double").alias("confidence"), F.format_string("Share %d entities", "shared").alias("explanation"),
    )


def relink(links: DataFrame, made: DataFrame) -> DataFrame:
    """Links without those that follow from entities, and with what the matchers have made anew; the first of a key stays."""
    kept = links.filter(~F.col("link_type").isin(*ENTITY_LINKS))
    keys = ["source_id", "target_type", "target_id", "link_type"]
    return upsert.insert_new(kept, made, keys, ["explanation"])
