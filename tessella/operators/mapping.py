"""Mapping whole sources: the four matchers' models in state, the scores of chosen fields, and their composition.

Local models hold what a matcher needs of a source, one part of a table for each source; global models hold what it needs
of the attributes and are rebuilt whole. Scoring reads both, cut to the chosen fields before anything is joined.

cells (source_id, field_id, entity_id, value), fields (field_id, source_id, name), attributes (global_id, name), mappings
(local_id, global_id, confidence, authority), dictionary (global_id, value).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import typed_stems
from ..sources.state import StateStore
from . import affinity as aff
from . import compose, distributions, mdl, name_qgrams, value_tokens
from .compose import METHODS
from .vectors import cosine, weighted

#: The matchers of the quick path, which leaves out the test of numeric distributions.
QUICK = ("qgrams", "ngrams", "mdl")


def local_models(cells: DataFrame, fields: DataFrame, tokenizer: Callable[[Column], Column] = typed_stems) -> dict[str, DataFrame]:
    """The local models of all fields, by the names of their state tables; each has a source_id."""
    owners = fields.select("field_id", "source_id")
    return {
        "field_grams": name_qgrams.local_grams(fields),
        "field_tokens": value_tokens.local_tokens(cells, tokenizer),
        "field_values": mdl.local_dictionary(cells),
        "field_moments": distributions.moments(cells).join(owners, "field_id"),
    }


def preprocess_source(store: StateStore, cells: DataFrame, fields: DataFrame, source_id: int, tokenizer: Callable[[Column], Column] = typed_stems) -> None:
    """Local models of one source; doing it again replaces them."""
    own = F.col("source_id") == source_id
    for name, rows in local_models(cells.where(own), fields.where(own), tokenizer).items():
        store.put(name, f"source{source_id}", rows)


def preprocess_all(store: StateStore, cells: DataFrame, fields: DataFrame, tokenizer: Callable[[Column], Column] = typed_stems) -> None:
    """Local models of all sources in one job for each matcher."""
    for name, rows in local_models(cells, fields, tokenizer).items():
        store.write(name, rows)


def preprocess_global(store: StateStore, attributes: DataFrame, mappings: DataFrame, dictionary: DataFrame, tokenizer: Callable[[Column], Column] = typed_stems) -> None:
    """All global models, from the stored local ones and the mappings."""
    affinity = aff.affinities(mappings)
    store.write("attribute_grams", name_qgrams.global_grams(store.read("field_grams"), attributes, affinity))
    tokens = store.write("attribute_tokens", value_tokens.global_tokens(store.read("field_tokens"), dictionary, affinity, tokenizer))
    store.write("attribute_token_idf", value_tokens.token_idf(tokens, attributes))
    store.write("attribute_values", mdl.global_dictionary(store.read("field_values"), aff.training_mappings(mappings)))
    store.write("attribute_moments", distributions.global_moments(store.read("field_moments").drop("source_id"), affinity))


def chosen_fields(fields: DataFrame, mappings: DataFrame | None = None, source_id: int | None = None, predicate: str | None = None) -> DataFrame:
    """Fields of a source, for which a SQL predicate holds, without any mapping; what is None does not restrict."""
    out = fields if source_id is None else compose.for_source(fields, source_id)
    out = out if predicate is None else compose.for_fields(out, predicate)
    return out if mappings is None else compose.unmapped(out, mappings)


def scores(store: StateStore, method: str, wanted: DataFrame, attributes: DataFrame) -> DataFrame:
    """(field_id, global_id, score) of one matcher for the wanted fields (field_id), from the stored models."""
    mine = lambda name: store.read(name).join(wanted.select("field_id"), "field_id", "left_semi")
    if method == "qgrams":
        local, glob = mine("field_grams"), store.read("attribute_grams")
        idf = name_qgrams.gram_idf(local, glob, attributes)
        return cosine(weighted(local, idf, "gram"), weighted(glob, idf, "gram"), "gram", "field_id", "global_id")
    if method == "ngrams":
        idf = store.read("attribute_token_idf")
        return cosine(weighted(mine("field_tokens"), idf, "gram"), weighted(store.read("attribute_tokens"), idf, "gram"), "gram", "field_id", "global_id")
    if method == "mdl":
        return mdl.scores(mine("field_values"), store.read("attribute_values"))
    if method == "dist":
        return distributions.scores_of(mine("field_moments"), store.read("attribute_moments"))
    raise ValueError(f"no such matcher: {method!r}")


def score_fields(store: StateStore, wanted: DataFrame, attributes: DataFrame, methods: Iterable[str] = METHODS) -> DataFrame:
    """Raw results (source_id, field_id, method_name, match_id, score) of the wanted fields (field_id, source_id)."""
    return compose.raw_results(wanted, **{m: scores(store, m, wanted, attributes) for m in methods})


def map_source(store: StateStore, fields: DataFrame, attributes: DataFrame, mappings: DataFrame, source_id: int, methods: Iterable[str] = QUICK, only_unmapped: bool = True) -> DataFrame:
    """The composite scores of a source's fields; raw and composite scores are kept as the source's parts."""
    wanted = chosen_fields(fields, mappings if only_unmapped else None, source_id)
    store.put("raw_scores", f"source{source_id}", score_fields(store, wanted, attributes, methods))
    weights = compose.default_methods(store.spark)
    store.put("composite_scores", f"source{source_id}", compose.composite(store.read("raw_scores", f"source{source_id}"), weights))
    return store.read("composite_scores", f"source{source_id}")


def process_source(store: StateStore, cells: DataFrame, fields: DataFrame, attributes: DataFrame, mappings: DataFrame, dictionary: DataFrame, source_id: int, methods: Iterable[str] = METHODS, tokenizer: Callable[[Column], Column] = typed_stems) -> DataFrame:
    """One source end to end: local models, global models with it, scores of its unmapped fields."""
    preprocess_source(store, cells, fields, source_id, tokenizer)
    preprocess_global(store, attributes, mappings, dictionary, tokenizer)
    return map_source(store, fields, attributes, mappings, source_id, methods)


def test_mapping(store: StateStore, cells: DataFrame, fields: DataFrame, attributes: DataFrame, mappings: DataFrame, dictionary: DataFrame, gold: DataFrame, sources: list[int], methods: Iterable[str] = METHODS, tokenizer: Callable[[Column], Column] = typed_stems) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accuracy by matcher, of the weighted composite and of the votes, on test sources whose gold (field_id, tag_id) is held back.

    Models are built from all sources but learn no mapping of the test sources' fields.
    """
    held = compose.for_fields(fields, f"source_id in ({', '.join(str(int(s)) for s in sources)})") if sources else fields.limit(0)
    known = mappings.join(held.select(F.col("field_id").alias("local_id")), "local_id", "left_anti").select(mappings.columns)
    preprocess_all(store, cells, fields, tokenizer)
    preprocess_global(store, attributes, known, dictionary, tokenizer)
    raw = store.write("raw_scores", score_fields(store, held, attributes, methods))
    return accuracies(raw, compose.default_methods(store.spark), gold)


def accuracies(raw: DataFrame, weights: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(by matcher, of the composite, of the votes): how often the best match is the gold one."""
    whole = lambda rows: compose.accuracy(rows.withColumn("method_name", F.lit("all")), gold, ["method_name"])
    return compose.accuracy(compose.raw_max(raw), gold, ["method_name"]), whole(compose.composite_max(raw, weights)), whole(compose.votes_max(raw, weights))
