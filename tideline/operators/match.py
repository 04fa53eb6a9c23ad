"""Postings against profiles: ranked projects and skills, guards of rewritten texts, transcripts and plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tideline.functions.shared import stored
from tideline.functions.text import keyword_tokens, numbers
from tideline.operators.pages import MOST_CHARS, text_of_html

FLOOR = 0.8
BULLET = r"^\s*(?:[-*•]|\d{1,3}[.)])\s+"


CANDIDATES = 40
FEW_PROJECTS = 64  #: projects that are counted in a posting's row
MOST_TERMS = 20_000  #: words of projects up to which postings are searched for them; beyond, the words of both are joined


def posting_text(jobs: DataFrame) -> Column:
    """Title, the text of the fuller description up to ``MOST_CHARS``, and a user's context under its own heading."""
    have = [F.nullif(F.col(c), F.lit("")) for c in ("full_description", "description") if c in jobs.columns]
    context = F.trim(F.col("extra_context")) if "extra_context" in jobs.columns else F.lit(None).cast("string")
    more = F.concat(F.lit("\n\nAdditional context:\n"), F.nullif(context, F.lit("")))
    return F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), text_of_html(F.coalesce(*have, F.lit("")), MOST_CHARS), F.coalesce(more, F.lit("")))


def candidate_pool(jobs: DataFrame, projects: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The projects that a rewriter is shown for each posting: at most ``most``, by common words, then in their order."""
    return overlap_topk(jobs, projects, most)


def overlap_topk(jobs: DataFrame, projects: DataFrame, k: int) -> DataFrame:
    """(job_uid, project, ord, score, rank): the k projects that share the most keywords with each posting.

    ``jobs`` is (job_uid, text), ``projects`` (project, ord, text). Ties keep the projects' order, and projects without
    a common word fill up what is left. Few projects are counted in the posting's own row; with more, the scores join on
    the word, of which each side has each once.
    """
    terms = projects.select("project", "ord", F.explode(keyword_tokens(F.col("text"))).alias("word")).distinct()
    # a posting's words that no project has are left before they become rows
    wanted = terms.select("word").distinct().limit(MOST_TERMS + 1).collect()
    words = F.array_distinct(keyword_tokens(F.col("text")))
    broadcast = False
    if len(wanted) <= MOST_TERMS:
        words = F.array_intersect(words, F.lit([w.word for w in wanted]).cast("array<string>"))
        broadcast = terms.limit(MOST_TERMS * 10 + 1).count() <= MOST_TERMS * 10
        few = projects.select("project", "ord").orderBy("ord", "project").limit(FEW_PROJECTS + 1).collect()
        if broadcast and len(few) == len(set(few)) <= FEW_PROJECTS and all(p.project is not None and p.ord is not None for p in few):
            return _by_row(jobs.select("job_uid", words.alias("words")), few, terms, k)
    found = jobs.select("job_uid", F.explode(words).alias("word"))
    scored = found.join(F.broadcast(terms) if broadcast else terms, "word").select("job_uid", "project", "ord", F.lit(1).cast("long").alias("score"))
    each = _with_first(scored, jobs.select("job_uid").distinct(), projects, k)
    return _first_k(each.groupBy("job_uid", "project", "ord").agg(F.sum("score").alias("score")), k)


def _by_row(jobs: DataFrame, projects: list, terms: DataFrame, k: int) -> DataFrame:
    """The first k of a few projects, in their order, for (job_uid, words): a posting is one row with a score a project."""
    if not projects:
        kind = dict(terms.dtypes)
        return jobs.sparkSession.createDataFrame([], f"job_uid {dict(jobs.dtypes)['job_uid']}, project {kind['project']}, ord {kind['ord']}, score long, rank long")
    of = {(p.project, p.ord): i for i, p in enumerate(projects)}
    having: list[list[str]] = [[] for _ in projects]
    for t in terms.collect():
        having[of[t.project, t.ord]].append(t.word)
    lists = F.array(*[F.lit(words).cast("array<string>") for words in having])
    # the words are bound to a variable of a lambda, so that they are found once and not once a project
    scores = F.transform(F.array("words"), lambda w: F.transform(lists, lambda p: F.size(F.array_intersect(w, p))))[0]
    rows = jobs.select("job_uid", scores.alias("scores"))
    summed = rows.groupBy("job_uid").agg(*[F.sum(F.col("scores")[i]).alias(f"s{i}") for i in range(len(projects))])
    in_order = F.array_sort(F.array(*[F.struct((-F.col(f"s{i}")).alias("less"), F.lit(i).alias("i")) for i in range(len(projects))]))
    named = F.array(*[F.struct(F.lit(p.project).cast(terms.schema["project"].dataType).alias("project"), F.lit(p.ord).cast(terms.schema["ord"].dataType).alias("ord")) for p in projects])
    best = summed.select("job_uid", F.posexplode(F.slice(in_order, 1, k)).alias("at", "best")).withColumn("of", named[F.col("best.i")])
    return best.select("job_uid", "of.project", "of.ord", (-F.col("best.less")).alias("score"), (F.col("at") + 1).cast("long").alias("rank"))


def _with_first(scored: DataFrame, jobs: DataFrame, projects: DataFrame, k: int) -> DataFrame:
    """The scores, and a zero more for the first k projects of each posting; no later ones without a common word can matter."""
    few = projects.orderBy("ord", "project").select("project", "ord").limit(k).collect()
    if not few:
        return scored
    first = F.array(*[F.struct(F.lit(p.project).alias("project"), F.lit(p.ord).cast(dict(projects.dtypes)["ord"]).alias("ord"), F.lit(0).cast("long").alias("score")) for p in few])
    return scored.unionByName(jobs.select("job_uid", F.inline(first)))


def _first_k(scored: DataFrame, k: int) -> DataFrame:
    first = W.partitionBy("job_uid").orderBy(F.col("score").desc(), "ord", "project")
    return scored.withColumn("rank", F.row_number().over(first).cast("long")).where(F.col("rank") <= k)


#: Projects and postings that a block holds at most, words that it holds before it is closed, blocks of postings that are made if
#: there are so many, blocks of projects that a task meets at most, and how often a dense product is cheaper than a count of its pairs.
BLOCK, ENTRIES, POSTING_BLOCKS, MET, DENSE = 8192, 1 << 22, 48, 32, 64
#: Scores, and pairs of a posting and a project with a common word, that a task holds at once.
CELLS, PAIRS = 1 << 19, 1 << 22


def overlap_topk_many(jobs: DataFrame, projects: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """As ``overlap_topk``, for very many projects: each block of postings meets each block of projects.

    Postings are shuffled once, and projects once more to be stored in blocks, which tasks read again for each block of
    postings; no row is copied to the blocks that it meets. A task keeps the first k of each posting over the blocks of
    projects that it meets, up to ``MET``. The work is the square of the input, a task's memory is bounded.
    """
    n_jobs, n_projects = jobs.count(), projects.count()
    words = keyword_tokens(F.col("text")).alias("words")
    of_jobs = max(-(-n_jobs // BLOCK), min(POSTING_BLOCKS, -(-n_jobs // 256)), 1)
    left = _packed(jobs.select("job_uid", words), ["job_uid"], of_jobs, BLOCK)
    size = max(min(block, BLOCK), 1)
    right = stored(_packed(projects.select("project", "ord", words), ["project", "ord"], max(-(-n_projects // BLOCK), 1), size), "projects")
    right = right.coalesce(max(-(-n_projects // (MET * size)), 1)).select("project", "ord", *[F.col(c).alias(f"their_{c}") for c in ("words", "sizes", "codes")])
    schema = StructType([jobs.schema["job_uid"], *(StructField(c, projects.schema[c].dataType) for c in ("project", "ord")), StructField("score", LongType())])
    # a product of partitions, which neither copies nor shuffles the blocks, at any size
    best = left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(lambda pairs: _best_of_pairs(pairs, k), schema)
    return _first_k(best, k)


def _packed(rows: DataFrame, keys: list[str], parts: int, most: int, entries: int = ENTRIES) -> DataFrame:
    """Blocks of at most ``most`` rows of (*keys, words): the keys and the numbers of words as lists, the block's distinct words,
    and the places of each row's words among them. Rows of equal keys are one; only a block of one row has more than ``entries`` words."""
    kinds = {c: rows.schema[c].dataType for c in keys} | {"words": StringType(), "sizes": IntegerType(), "codes": IntegerType()}
    schema = StructType([StructField(c, ArrayType(kind)) for c, kind in kinds.items()])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            came = pa.Table.from_batches([batch])
            held = _of_equal_keys(came if held is None else pa.concat_tables([held, came]), keys)
            while (cut := _fits(held, most, entries)) < len(held):  # so the last row stays, as more of its key may come
                yield _pack(held.slice(0, cut), keys, schema)
                held = held.slice(cut)
        if held is not None and len(held):
            yield _pack(held, keys, schema)

    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(packs, schema)


def _of_equal_keys(rows: pa.Table, keys: list[str]) -> pa.Table:
    """Neighbours of equal keys as one row with the words of all."""
    codes = [rows[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in keys]
    starts = np.ones(len(rows), bool)
    starts[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
    if starts.all():
        return rows
    row, flat = _values(rows, "words")
    encoded = flat.dictionary_encode()
    wide = max(len(encoded.dictionary), 1)
    pairs = np.unique((np.cumsum(starts) - 1)[row] * wide + encoded.indices.to_numpy(zero_copy_only=False))
    ends = np.searchsorted(pairs, np.arange(starts.sum() + 1) * wide)
    words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), encoded.dictionary.take(pa.array(pairs % wide)))
    return rows.filter(pa.array(starts)).select(keys).append_column("words", words.cast(rows.schema.field("words").type))


def _fits(rows: pa.Table, most: int, entries: int) -> int:
    """How many rows a block takes."""
    ends = np.cumsum(pc.list_value_length(rows["words"]).to_numpy())
    return min(most, max(int(np.searchsorted(ends, entries, side="right")), 1))


def _pack(rows: pa.Table, keys: list[str], schema: StructType) -> pa.RecordBatch:
    words = _values(rows, "words")[1].dictionary_encode()
    whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    lists = [*(rows[c].combine_chunks() for c in keys), words.dictionary, pc.list_value_length(rows["words"]).combine_chunks(), words.indices]
    return pa.RecordBatch.from_arrays([whole(values) for values in lists], names=schema.names)


def _best_of_pairs(pairs: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(job_uid, project, ord, score) of pairs of blocks: the first k of each posting over neighbours with one block of postings."""
    jobs = best = None
    for batch in pairs:
        for i in range(len(batch)):
            at = {c: batch.column(c)[i].values for c in batch.schema.names}
            if jobs is not None and not jobs.equals(at["job_uid"]):
                yield from best.to_batches()
                best = None
            jobs = at["job_uid"]
            came = _best_of_block(*_in_common_words(at), k)
            best = came if best is None else _better(best, came, len(jobs), k)
    if best is not None:
        yield from best.to_batches()


def _in_common_words(at: dict[str, pa.Array]) -> tuple[pa.Table, pa.Table]:
    """Both sides of a pair of blocks with their words as ``ids``: the places among the words of the projects; others are left out."""
    place = pc.fill_null(pc.index_in(at["words"], value_set=at["their_words"]), -1).to_numpy(zero_copy_only=False)
    ids = place[at["codes"].to_numpy()]
    sizes = at["sizes"].to_numpy()
    ends = np.concatenate([[0], np.cumsum(ids >= 0)])[np.concatenate([[0], np.cumsum(sizes)])]
    lists = lambda ends, ids: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int64()))
    jobs = pa.table({"job_uid": at["job_uid"], "ids": lists(ends, ids[ids >= 0])})
    ends = np.concatenate([[0], np.cumsum(at["their_sizes"].to_numpy())])
    return jobs, pa.table({"project": at["project"], "ord": at["ord"], "ids": lists(ends, at["their_codes"].to_numpy())})


def _better(one: pa.Table, other: pa.Table, n: int, k: int) -> pa.Table:
    """The first k of each of n postings in two tables, each of which has as many rows for every posting, in one order of postings."""
    row = np.concatenate([np.repeat(np.arange(n), len(t) // n) for t in (one, other)])
    both = pa.concat_tables([one, other]).append_column("row", pa.array(row))
    order = pc.sort_indices(both, [("row", "ascending"), ("score", "descending"), ("ord", "ascending"), ("project", "ascending")], null_placement="at_start")
    first = np.arange(len(both)) % (len(both) // n) < k
    return both.take(order.filter(pa.array(first))).drop_columns("row")


def _best_of_block(jobs: pa.Table, projects: pa.Table, k: int) -> pa.Table:
    """(job_uid, project, ord, score): the first k of these projects for each of these postings, scores of zero too.

    Words that many of both have are a matrix product; the others count their pairs.
    """
    projects = projects.take(pc.sort_indices(projects, [("ord", "ascending"), ("project", "ascending")], null_placement="at_start"))
    n, m = len(jobs), len(projects)
    k = min(k, m)
    job_of, job_word = _entries(jobs)
    project_of, project_word = _entries(projects)
    known, column = np.unique(project_word, return_inverse=True)
    at = np.minimum(np.searchsorted(known, job_word), max(len(known) - 1, 0))
    met = known[at] == job_word if len(known) else np.zeros(len(job_word), bool)
    job_of, at = job_of[met], at[met]
    per_project = np.bincount(column, minlength=len(known))
    dense = np.bincount(at, minlength=len(known)) * per_project * DENSE > n * m
    place = np.cumsum(dense) - 1
    theirs = np.zeros((int(dense.sum()), m), np.float32)
    theirs[place[column[dense[column]]], project_of[dense[column]]] = 1
    having = project_of[np.argsort(column, kind="stable")]
    first = np.cumsum(per_project) - per_project
    step = max(CELLS // max(m, 1), 1)
    found, scores_of = np.empty((n, k), np.int64), np.empty((n, k), np.int64)
    for low in range(0, n, step):
        high = min(low + step, n)
        here = slice(*np.searchsorted(job_of, [low, high]))
        row, word = job_of[here] - low, at[here]
        mine = np.zeros((high - low, len(theirs)), np.float32)
        mine[row[dense[word]], place[word[dense[word]]]] = 1
        scores = mine @ theirs
        row, word = row[~dense[word]], word[~dense[word]]
        ends = np.cumsum(per_project[word])
        cuts = np.unique(np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS), side="right")) if len(ends) else []
        for rows, some in zip(np.split(row, cuts), np.split(word, cuts), strict=True):
            length = per_project[some]
            pair = np.arange(length.sum()) + np.repeat(first[some] - (np.cumsum(length) - length), length)
            scores += np.bincount(np.repeat(rows * m, length) + having[pair], minlength=scores.size).reshape(scores.shape)
        every = np.arange(high - low)
        for i in range(k):  # the first of the highest is the first by ord and name
            found[low:high, i] = scores.argmax(axis=1)
            scores_of[low:high, i] = scores[every, found[low:high, i]]
            scores[every, found[low:high, i]] = -1
    of = projects.take(pa.array(found.ravel()))
    return pa.table({"job_uid": jobs["job_uid"].take(pa.array(np.repeat(np.arange(n), k))), "project": of["project"], "ord": of["ord"], "score": pa.array(scores_of.ravel())})


def _entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row number and word id of all entries of ``ids``, by row."""
    row, ids = _values(rows, "ids")
    return row, ids.to_numpy(zero_copy_only=False)


def _values(rows: pa.Table, column: str) -> tuple[np.ndarray, pa.Array]:
    """Row number and value of all entries of a list column, by row."""
    lists = rows[column].combine_chunks()
    return np.repeat(np.arange(len(rows)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()


def ranked_groups(groups: Column, keywords: Column) -> Column:
    """Skill groups by how many items touch a keyword, in their order where equal."""
    touched = lambda g: F.size(F.filter(g["items"], lambda i: F.arrays_overlap(keyword_tokens(i), keywords)))
    keyed = F.transform(groups, lambda g, i: F.struct((-touched(g)).alias("less"), i.alias("at"), g.alias("group")))
    return F.transform(F.array_sort(keyed), lambda x: x["group"])


def rewritten_bullets(replies: DataFrame) -> DataFrame:
    """(key, section, project, ord, bullet) of (key, reply): lines below ``### name`` headers, without list marks.

    A reply without any header has its lines under a null project.
    """
    lines = replies.select("key", F.posexplode(F.split("reply", r"\r\n|\r|\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    so_far = W.partitionBy("key").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    head = F.col("line").startswith("### ")
    rows = lines.withColumn("project", F.last(F.when(head, F.trim(F.substring("line", 5, 1 << 20))), ignorenulls=True).over(so_far)).withColumn("section", F.count_if(head).over(so_far))
    any_head = F.max(head).over(W.partitionBy("key"))
    rows = rows.withColumn("any", any_head).where(~head & (F.col("line") != "") & (F.col("project").isNotNull() | ~F.col("any")) & ~(F.col("project").isNotNull() & F.col("line").startswith("(")))
    return rows.select("key", "section", "project", F.col("at").alias("ord"), F.trim(F.regexp_replace("line", BULLET, "")).alias("bullet"))


def guard_bullets(originals: DataFrame, rewrites: DataFrame) -> DataFrame:
    """(key, project, bullets, rejected, fell_back) per project that a reply names and that exists.

    ``originals`` is (key, project, bullets), ``rewrites`` (key, project, ord, bullet). A bullet with a number that the
    project's own do not have is rejected; no more stay than there were, and with none left the originals do.
    """
    source = originals.select("key", "project", "bullets", F.array_distinct(F.flatten(F.transform("bullets", lambda b: numbers(b)))).alias("known"))
    rows = rewrites.where(F.trim("bullet") != "").join(source, ["key", "project"])
    ok = F.size(F.array_except(numbers(F.col("bullet")), F.col("known"))) == 0
    kept = F.array_sort(F.collect_list(F.when(ok, F.struct("ord", F.trim("bullet").alias("text")))))
    per = rows.groupBy("key", "project").agg(F.first("bullets").alias("original"), kept.alias("kept"), F.max(~ok).alias("rejected"))
    texts = F.transform(F.slice("kept", 1, F.greatest(F.size("original"), F.lit(1))), lambda x: x["text"])
    none = F.size("kept") == 0
    return per.select("key", "project", F.when(none, F.col("original")).otherwise(texts).alias("bullets"), "rejected", none.alias("fell_back"))


def unknown_projects(originals: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Names in replies that no project has."""
    return rewrites.select("key", "project").distinct().join(originals.select("key", "project"), ["key", "project"], "left_anti")


def preservation(source: Column, out: Column) -> Column:
    """The share of a text's numbers that another one still has; 1 without any."""
    have = numbers(source)
    return F.when(F.size(have) == 0, 1.0).otherwise(F.size(F.array_intersect(have, numbers(out))) / F.size(have))


def tailor(jobs: DataFrame, projects: DataFrame, rewrites: DataFrame | None = None, k: int = 4) -> DataFrame:
    """(job_uid, projects, preservation, flags): the guarded rewrites, or else the k projects with most in common.

    ``jobs`` is (job_uid, text), ``projects`` (project, ord, text, bullets), ``rewrites`` (job_uid, project, ord, bullet).
    """
    top = overlap_topk(jobs, projects.select("project", "ord", "text"), k).join(projects.select("project", "bullets"), "project")
    pick = top.select("job_uid", F.col("rank").alias("at"), "project", "bullets", F.col("bullets").alias("original"), F.lit(False).alias("rejected"), F.lit(False).alias("fell_back"), F.lit(False).alias("used"))
    if rewrites is not None:
        per_job = jobs.select(F.col("job_uid").alias("key")).distinct().join(rewrites.withColumnRenamed("job_uid", "key").select("key", "project").distinct(), "key").join(projects.select("project", "bullets"), "project")
        guarded = guard_bullets(per_job.select("key", "project", "bullets"), rewrites.withColumnRenamed("job_uid", "key"))
        order = rewrites.groupBy(F.col("job_uid").alias("key"), "project").agg(F.min("ord").alias("at"))
        guarded = guarded.join(order, ["key", "project"]).join(projects.select("project", F.col("bullets").alias("original")), "project")
        guarded = guarded.withColumn("at", F.row_number().over(W.partitionBy("key").orderBy("at"))).where(F.col("at") <= k)
        guarded = guarded.select(F.col("key").alias("job_uid"), "at", "project", "bullets", "original", "rejected", "fell_back", F.lit(True).alias("used"))
        pick = guarded.unionByName(pick.join(guarded.select("job_uid").distinct(), "job_uid", "left_anti"))
    item = F.struct("at", "project", "bullets", "original", "rejected", "fell_back", "used")
    rows = pick.groupBy("job_uid").agg(F.array_sort(F.collect_list(item)).alias("items"))
    flat = lambda c: F.array_join(F.flatten(F.transform("items", lambda x: x[c])), "\n")
    share = preservation(flat("original"), flat("bullets"))
    noted = lambda flag, text: F.transform(F.filter("items", lambda x: x[flag]), lambda x: F.concat(x["project"], F.lit(text)))
    low = F.when(share < FLOOR, F.array(F.lit("low fact preservation"))).otherwise(F.array().cast("array<string>"))
    flags = F.concat(noted("rejected", ": rejected a rewrite with unsupported facts"), noted("fell_back", ": kept the original bullets"), low)
    return rows.select("job_uid", F.transform("items", lambda x: F.struct(x["project"].alias("project"), x["bullets"].alias("bullets"))).alias("projects"), share.alias("preservation"), flags.alias("flags"), F.exists("items", lambda x: x["used"]).alias("used_rewrites"))


def last_result(lines: DataFrame) -> DataFrame:
    """(key, result, is_error, found) of (key, line_no, line): the last JSON line of type result, else all lines."""
    event = F.when(F.trim("line").startswith("{"), F.from_json("line", "type string, result string, is_error boolean"))
    rows = lines.withColumn("event", event)
    hit = F.col("event.type") == "result"
    last = F.max_by(F.col("event"), F.when(hit, F.col("line_no")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    out = rows.groupBy("key").agg(last.alias("event"), F.max(F.coalesce(hit, F.lit(False))).alias("found"), whole.alias("whole"))
    return out.select("key", F.when(F.col("found"), F.coalesce("event.result", F.lit(""))).otherwise(F.col("whole")).alias("result"), (F.col("found") & F.coalesce("event.is_error", F.lit(False))).alias("is_error"), "found")


def report_of(result: Column) -> Column:
    """struct(filled, unfilled, needs_login, notes) of the last ``RESULT:`` line, else the end of the text as notes."""
    marked = F.filter(F.transform(F.split(F.trim(result), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x.startswith("RESULT:"))
    last = F.try_element_at(marked, F.lit(-1))
    got = F.from_json(F.trim(F.substring(last, 8, 1 << 20)), "filled array<string>, unfilled array<string>, needs_login boolean, notes string, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    ok = last.isNotNull() & got["_corrupt_record"].isNull()
    none = F.array().cast("array<string>")
    tail = F.concat(F.lit("agent report unparsed; raw tail: "), F.substring(F.trim(result), -300, 300))
    return F.struct(
        F.when(ok, F.coalesce(got["filled"], none)).otherwise(none).alias("filled"), F.when(ok, F.coalesce(got["unfilled"], none)).otherwise(none).alias("unfilled"),
        (ok & F.coalesce(got["needs_login"], F.lit(False))).alias("needs_login"), F.when(ok, F.coalesce(got["notes"], F.lit(""))).otherwise(tail).alias("notes"),
    )


def plan_of(reply: Column, valid: Column | None = None) -> Column:
    """map<int,string> from the outermost braces of a reply: whole-number keys (of ``valid``) with texts that are not blank.

    JSON values other than texts do not count: they come as NULL from get_json_object on a quoted probe.
    """
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)
    entries = F.from_json(body, "map<string,string>")
    ints = F.map_filter(entries, lambda k, v: k.rlike(r"^\s*[+-]?\d+\s*$") & v.isNotNull() & (F.trim(v) != "") & body.rlike(r"(?s)\{.*\}"))
    texts = F.map_filter(ints, lambda k, v: F.contains(body, F.concat(F.lit('"'), k, F.lit('"'))))
    typed = F.map_from_entries(F.transform(F.map_entries(texts), lambda e: F.struct(F.trim(e["key"]).cast("int"), e["value"])))
    typed = F.coalesce(typed, F.create_map().cast("map<int,string>"))
    return typed if valid is None else F.map_filter(typed, lambda k, v: F.array_contains(valid, k))
