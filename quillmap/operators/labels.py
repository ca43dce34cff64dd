"""Label resolution: explicit mapping, records, folder and file names, text, vectors, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmap import constants as K
from quillmap.functions.text import (
    grams,
    has_any_word,
    is_label_noisy,
    most_frequent_word,
    once,
    parent_folder,
    stem,
    strip,
)
from quillmap.functions.vectors import arrow_once, list_array_to_matrix, unit_rows
from quillmap.session import collect_bounded


# --- records ----------------------------------------------------------------

def record_value(record: Column, key: Column) -> Column:
    """Lower-case trimmed value under ``key``; NULL when the record lacks it."""
    return F.lower(strip(F.try_element_at(record, key)))


def magic_key(record: Column, strict: bool = True) -> Column:
    """First key that contains a magic word and whose value is a usable name.

    ``strict=False`` keeps the historic inverted test, which accepts only noisy values.
    """
    def fits(entry: Column) -> Column:
        noisy = is_label_noisy(entry["value"])
        return has_any_word(entry["key"], K.RECORD_MAGIC_WORDS) & (~noisy if strict else noisy)

    return F.try_element_at(F.filter(F.map_entries(record), fits), F.lit(1))["key"]


def record_label(record: Column, plan_key: Column, folder_key: Column, strict: bool = True
                 ) -> Column:
    """By plan, else by the folder's remembered column, else by magic word."""
    return F.coalesce(
        record_value(record, plan_key), record_value(record, folder_key),
        record_value(record, magic_key(record, strict)),
    )


# --- names ------------------------------------------------------------------

def folder_file_label(path: Column) -> Column:
    """The folder's name unless it is noise, else the file's; NULL when both are noise."""
    def pick(name: Column) -> Column:
        folder_noise = is_label_noisy(name["folder"]) | name["folder"].isin(K.GENERIC_FOLDERS)
        return F.when(~folder_noise, name["folder"]).when(
            ~is_label_noisy(name["file"]), name["file"])

    return once(F.struct(parent_folder(path).alias("folder"), stem(path).alias("file")), pick)


# --- labels inside texts ----------------------------------------------------

# characters that are hashed at a time: some 40 bytes of work space for each
RUN_CHARS = 1 << 20


def _rolling(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes of a run of code points, and the powers that belong to them (modulo 2**64)."""
    powers = np.cumprod(np.full(len(codes) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    weighted = np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)])
    return np.concatenate([np.zeros(1, np.uint64), weighted.astype(np.uint64)]), powers


def _longest_by_hashes(text: Column, scope: Column, labels: list[tuple[str, str]], gram: int = 8,
                       run_chars: int = RUN_CHARS) -> Column:
    """The texts of a batch are hashed in runs of bounded length; the first characters of the labels (at
    most ``gram``) are looked up among a run's grams, and what matches is compared in full."""
    by_size: dict[int, dict[int, list[tuple[str, set[str]]]]] = {}
    owners: dict[str, set[str]] = {}
    for owner, label in labels:
        owners.setdefault(label, set()).add(owner)
    for label, own in owners.items():
        size = min(gram, len(label))
        prefix, _ = _rolling(np.array([ord(c) for c in label[:size]]))
        by_size.setdefault(size, {}).setdefault(int(prefix[size]), []).append((label, own))

    longest = max(map(len, owners), default=0)

    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = {n: np.array(sorted(h), dtype=np.uint64) for n, h in by_size.items()}
        for texts, scopes in batches:
            places = scopes.to_pylist()
            found: list[str | None] = [None] * len(places)
            for rows_of, parts in _runs(texts.to_pylist(), longest, run_chars):
                search(known, rows_of, parts, places, found)
            yield pa.array(found, pa.string())

    def search(known, rows_of, parts, places, found) -> None:
        run = "\0".join(parts)
        codes = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        lengths = np.array([len(v) for v in parts], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        prefix, _ = _rolling(codes)
        for size, hashes in known.items():
            if len(codes) < size:
                continue
            # a gram's hash is scaled by the power of its place, and so is a label's
            grams_at = prefix[size:] - prefix[:-size]
            inverse = _inverse_powers(len(grams_at))
            grams_at = grams_at * inverse
            # their first bits rule out nearly all grams
            some = np.zeros(1 << 16, dtype=bool)
            some[(hashes >> np.uint64(48)).astype(np.int64)] = True
            maybe = np.flatnonzero(some[(grams_at >> np.uint64(48)).astype(np.int64)])
            where = np.minimum(np.searchsorted(hashes, grams_at[maybe]), len(hashes) - 1)
            hit = hashes[where] == grams_at[maybe]
            at, slot = maybe[hit], where[hit]
            rows = np.searchsorted(starts, at, side="right") - 1
            if size < gram:                    # the whole label: one hit of a text is enough
                _, once_each = np.unique(rows * len(hashes) + slot, return_index=True)
                at, rows = at[once_each], rows[once_each]
            for place, part, h in zip(at.tolist(), rows.tolist(), grams_at[at].tolist()):
                row = rows_of[part]
                for label, own in by_size[size][h]:
                    best = found[row]
                    if best is not None and (len(label), label) <= (len(best), best):
                        continue
                    if places[row] in own and run.startswith(label, place):
                        found[row] = label

    return arrow_once(find, "string")(text, scope)


def _runs(texts: list[str | None], overlap: int, size: int) -> Iterator[tuple[list[int], list[str]]]:
    """(row of each part, parts) of about ``size`` characters; long texts are cut, with an overlap in
    which every label fits."""
    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), size):
            part = text[at:at + size + overlap]
            rows.append(row)
            parts.append(part)
            held += len(part)
            if held >= size:
                yield rows, parts
                rows, parts, held = [], [], 0
    if parts:
        yield rows, parts


def _inverse_powers(n: int) -> np.ndarray:
    step = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    out = np.full(n, step, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


# bits of the filter that texts are held against where labels are too many to ship: 16 MB, three bits a label
FILTER_BITS, FILTER_HASHES = 27, 3


def _filter_bits(hashes: np.ndarray) -> list[np.ndarray]:
    """Places of a gram's bits."""
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return [((mixed * np.uint64(2 * i + 1)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) for i in range(FILTER_HASHES)]


def gram_filter(grams_of_labels: DataFrame) -> np.ndarray:
    """A bit map that holds every gram of a column ``g``; of bounded size, however many there are.

    Tasks send words of the map, which are combined before they reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [int(_rolling(np.array([ord(c) for c in g]))[0][-1]) for g in batch.column(0).to_pylist() if g]
            at = np.unique(np.concatenate(_filter_bits(np.array(hashes, dtype=np.uint64)))) if hashes else np.zeros(0, np.int64)
            yield pa.record_batch({"word": pa.array(at >> 5), "bits": pa.array(np.int64(1) << (at & 31))})

    words = grams_of_labels.select("g").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toArrow()               # at most 2 ** (FILTER_BITS - 5) rows
    out = np.zeros(1 << FILTER_BITS - 5, dtype=np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def label_candidates(df: DataFrame, id_col: str, text: Column, sizes: list[int], longest: int, gram: int,
                     held: np.ndarray) -> DataFrame:
    """(id, _scope, g, tail): the grams of each text that the filter holds, with what follows them as far as the longest
    label goes. A text sends each once."""
    shared = df.sparkSession.sparkContext.broadcast(held)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for rows_of, parts in _runs(batch.column(2).to_pylist(), longest, RUN_CHARS):
                whole = "\0".join(parts)
                codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
                starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
                prefix, _ = _rolling(codes)
                found = set()
                for size in sizes:
                    if len(codes) < size:
                        continue
                    hashes = (prefix[size:] - prefix[:-size]) * _inverse_powers(len(codes) - size + 1)
                    hit = np.arange(len(hashes))
                    for i in range(FILTER_HASHES):
                        place = _filter_bits(hashes[hit])[i]
                        hit = hit[(bits[place >> 5] >> (place & 31).astype(np.uint32)) & np.uint32(1) == 1]
                    of = np.searchsorted(starts, hit, side="right") - 1
                    for at, part in zip(hit.tolist(), of.tolist()):
                        end = int(starts[part + 1]) - 1
                        if at + size <= end:
                            g = whole[at:at + size]
                            found.add((rows_of[part], g, whole[at:min(end, at + longest)] if size == gram else g))
                rows, g, tail = zip(*found) if found else ((), (), ())
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(g, pa.string()), pa.array(tail, pa.string())],
                                                 names=[id_col, "_scope", "g", "tail"])

    return df.select(id_col, "_scope", text.alias("_t")).mapInArrow(
        run, f"`{id_col}` {kinds[id_col]}, _scope {kinds['_scope']}, g string, tail string")


def _longest_by_grams(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, out: str,
                      gram: int = 8) -> DataFrame:
    """Labels too many to ship: texts are held against a filter of the labels' first grams, and what it lets through is
    joined with the labels.

    Only those grams and the characters behind them are shuffled, never a text.
    """
    keyed = labels.select("_scope", "label", F.substring("label", 1, gram).alias("g"))
    known = keyed.agg(F.sort_array(F.collect_set(F.length("g"))).alias("s"), F.max(F.length("label")).alias("l")).head()
    if not known["s"]:
        return df.withColumn(out, F.lit(None).cast("string"))
    held = gram_filter(keyed.select("g").distinct())
    found = label_candidates(df, id_col, F.lower(F.col(text_col)), known["s"], known["l"], gram, held)
    pairs = found.join(keyed, ["_scope", "g"]).where(F.startswith(F.col("tail"), F.col("label")))
    best = pairs.groupBy(id_col).agg(
        F.max_by("label", F.struct(F.length("label").alias("n"), F.col("label").alias("l"))
                 ).alias(out))
    return df.join(best, id_col, "left")


def longest_label_in_text(
    df: DataFrame, text_col: str, labels: DataFrame, id_col: str = "doc_id",
    out: str = "text_label", scope_col: str | None = None, max_labels: int | None = None,
) -> DataFrame:
    """Add the longest label that is a substring of the lower-case text (ties: greatest name).

    With ``scope_col`` a label only counts for rows of its own scope (an archive, say).
    """
    scope = F.lit("") if scope_col is None else F.col(scope_col)
    names = labels.where("label <> ''").select(scope.alias("_scope"), "label").distinct()
    table = collect_bounded(names, max_labels)
    if table is None:
        return _longest_by_grams(df.withColumn("_scope", scope), id_col, text_col, names, out
                                 ).drop("_scope")
    listed = list(zip(table["_scope"].to_pylist(), table["label"].to_pylist()))
    if not listed:
        return df.withColumn(out, F.lit(None).cast("string"))
    return df.withColumn(out, _longest_by_hashes(F.lower(F.col(text_col)), scope, listed))


# --- label vectors ----------------------------------------------------------

# similarities that a task holds at a time: 16 MB, and as much for their rounded copy
TILE_CELLS = 1 << 21


def _best_in_block(rows, vectors: np.ndarray, scopes: list, keys: list[tuple[str, str]],
                   unit_refs: np.ndarray) -> list[tuple[int, str, float]]:
    """(row, label, similarity) of the most similar label of each row's scope.

    Nine digits make equal label vectors tie, whatever the block they are in; ``keys`` are sorted,
    and the first name wins.
    """
    members: dict[str, list[int]] = {}
    for i, (owner, _) in enumerate(keys):
        members.setdefault(owner, []).append(i)
    unit, ok = unit_rows(vectors)
    rows, unit = rows[ok], unit[ok]
    owners = np.array([scopes[r] for r in rows], dtype=object)
    found = []
    for owner, own in members.items():
        of_owner, refs = np.flatnonzero(owners == owner), unit_refs[own]
        step = max(1, TILE_CELLS // len(own))
        for i in range(0, len(of_owner), step):
            at = of_owner[i:i + step]
            sims = np.round(unit[at] @ refs.T, 9)
            best = sims.argmax(axis=1)
            found += zip(rows[at].tolist(), [keys[own[b]][1] for b in best],
                         sims[np.arange(len(at)), best].tolist())
    return found


def _nearest(vector: Column, scope: Column, keys: list[tuple[str, str]], refs: np.ndarray) -> Column:
    unit_refs, _ = unit_rows(refs)

    def nearest(v: pa.Array, scopes: pa.Array) -> pa.Array:
        rows, matrix = list_array_to_matrix(v, unit_refs.shape[1])
        found: list = [None] * len(v)
        for r, label, s in _best_in_block(rows, matrix, scopes.to_pylist(), keys, unit_refs):
            found[r] = {"label": label, "similarity": s}
        return pa.array(found, pa.struct([("label", pa.string()), ("similarity", pa.float64())]))

    return arrow_once(nearest, "struct<label:string,similarity:double>")(vector, scope)


def _nearest_by_blocks(df: DataFrame, id_col: str, vector_col: str, scope: Column, keyed: DataFrame,
                       block_labels: int, block_rows: int) -> DataFrame:
    """(id, _best, similarity) when the labels are too many to ship: a grid of bounded blocks."""
    n_cols = max(1, -(-keyed.count() // block_labels))
    asked = df.select(id_col, F.col(vector_col).alias("_v"), scope.alias("_scope")).where(
        "_v IS NOT NULL")
    n_rows = max(1, -(-asked.count() // block_rows))
    left = asked.withColumns({
        "_r": F.pmod(F.xxhash64(id_col), F.lit(n_rows)).cast("int"),
        "_c": F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1)))})
    right = keyed.withColumns({
        "_c": F.pmod(F.xxhash64("_scope", "label"), F.lit(n_cols)).cast("int"),
        "_r": F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))})
    schema = T.StructType([df.schema[id_col], T.StructField("_best", T.StringType()),
                           T.StructField("_s", T.DoubleType())])

    def block(rows: pa.Table, labels: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and labels.num_rows:
            labels = labels.sort_by([("_scope", "ascending"), ("label", "ascending")])
            at, refs = list_array_to_matrix(labels["vector"])
            pairs = list(zip(labels["_scope"].to_pylist(), labels["label"].to_pylist()))
            unit_refs, _ = unit_rows(refs)
            where, matrix = list_array_to_matrix(rows["_v"], refs.shape[1])
            found = _best_in_block(where, matrix, rows["_scope"].to_pylist(),
                                   [pairs[i] for i in at], unit_refs)
        return pa.table({
            id_col: rows[id_col].take(pa.array([r for r, _, _ in found], pa.int64())),
            "_best": pa.array([x for _, x, _ in found], pa.string()),
            "_s": pa.array([s for _, _, s in found], pa.float64())})

    hits = left.groupBy("_r", "_c").cogroup(right.groupBy("_r", "_c")).applyInArrow(block, schema)
    best = hits.groupBy(id_col).agg(F.min(F.struct((-F.col("_s")).alias("d"), "_best")).alias("b"))
    return best.select(id_col, F.col("b._best").alias("_best"), (-F.col("b.d")).alias("similarity"))


def nearest_label(
    df: DataFrame, vector_col: str, label_vectors: DataFrame,
    threshold: float = K.SEMANTIC_THRESHOLD, id_col: str = "doc_id", out: str = "vector_label",
    scope_col: str | None = None, max_labels: int | None = None,
    block_labels: int = 4_096, block_rows: int = 65_536,
) -> DataFrame:
    """Add the label whose vector is most similar, if above the threshold, and its similarity.

    ``label_vectors`` is ([scope,] label, vector). A size-checked label matrix is multiplied batch
    by batch; a larger one block by block, by the same kernel and with the same result.
    """
    scope = F.lit("") if scope_col is None else F.col(scope_col)
    keyed = label_vectors.where("vector IS NOT NULL").select(
        scope.alias("_scope"), "label", "vector")
    table = collect_bounded(keyed.orderBy("_scope", "label"), max_labels)
    if table is not None and table.num_rows == 0:
        return df.withColumns({"similarity": F.lit(None).cast("double"),
                               out: F.lit(None).cast("string")})
    if table is not None:
        rows, refs = list_array_to_matrix(table["vector"])
        pairs = list(zip(table["_scope"].to_pylist(), table["label"].to_pylist()))
        best = _nearest(F.col(vector_col), scope, [pairs[r] for r in rows], refs)
        scored = df.withColumn("_b", best).withColumns(
            {"_best": F.col("_b.label"), "similarity": F.col("_b.similarity")}).drop("_b")
    else:
        scored = df.join(_nearest_by_blocks(df, id_col, vector_col, scope, keyed, block_labels,
                                            block_rows), id_col, "left")
    return scored.withColumn(out, F.when(F.col("similarity") > threshold, F.col("_best"))
                             ).drop("_best")


# --- cascade ----------------------------------------------------------------

CASCADE = [
    # (method, column that holds its proposal), first non-null wins
    ("explicit_mapping", "explicit_label"),
    ("suggested", "suggested_label"),
    ("record", "record_label"),
    ("folder_file", "folder_file_label"),
    ("text", "text_label"),
    ("vector", "vector_label"),
    ("statistic", "auto_label"),
]


def cascade(
    df: DataFrame, text_col: str, vector_col: str, labels: DataFrame,
    label_vectors: DataFrame, threshold: float = K.SEMANTIC_THRESHOLD, id_col: str = "doc_id",
    scope_col: str | None = None,
) -> DataFrame:
    """Resolve labels; the costly levels only see rows that the cheaper ones left open.

    ``df`` already has whichever of explicit_label, record_label and folder_file_label apply.
    """
    cheap = [c for c in ("explicit_label", "suggested_label", "record_label", "folder_file_label")
             if c in df.columns]
    df = df.withColumn("_open", F.coalesce(*[F.col(c) for c in cheap]).isNull())
    df = df.withColumn("_open_text", F.when(F.col("_open"), F.col(text_col)))
    df = longest_label_in_text(df, "_open_text", labels, id_col, scope_col=scope_col)
    df = df.withColumn("_open", F.col("_open") & F.col("text_label").isNull())
    df = df.withColumn("_open_vector", F.when(F.col("_open"), F.col(vector_col)))
    df = nearest_label(df, "_open_vector", label_vectors, threshold, id_col, scope_col=scope_col)
    still = F.col("_open") & F.col("vector_label").isNull()
    df = df.withColumn("auto_label", F.when(still, most_frequent_word(F.col(text_col))))
    return resolve_labels(df).drop("_open", "_open_text", "_open_vector")


def resolve_labels(df: DataFrame) -> DataFrame:
    """Add label and label_method from whichever proposal columns the frame has."""
    present = [(m, c) for m, c in CASCADE if c in df.columns]
    method = F.lit("none")
    for name, col in reversed(present):
        method = F.when(F.col(col).isNotNull(), name).otherwise(method)
    return df.withColumns({
        "label": F.coalesce(*[F.col(c) for _, c in present], F.lit("unknown")),
        "label_method": method,
    })


def needs_refinement(label: Column, content: Column) -> Column:
    """Noisy or unknown label of a document that has content to refine it from."""
    return (is_label_noisy(label) | (label == "unknown")) & (
        F.coalesce(content, F.lit("")) != "")


