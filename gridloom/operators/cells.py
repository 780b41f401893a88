"""Cell lists: reading, checking, filling from fragments, voting over drafts, writing as HTML.

A payload is a struct of columns, cells, ignored and ocr_missed. In long form, cells are rows
(doc_id, ord, r, c, rs, cs, h, t, b, p, f), ord their place in the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.kinds import folded, norm, plurality
from gridloom.functions.text import once, outer_json
from gridloom.operators.folds import Rows, by_page
from gridloom.sources.scratch import met

# The payload's fields.
CELL = "struct<r:int,c:int,rs:int,cs:int,h:boolean,t:string,b:array<double>,p:int,f:array<int>>"
PAYLOAD = f"struct<columns:array<struct<name:string,kind:string>>,cells:array<{CELL}>,ignored:array<int>,ocr_missed:array<struct<t:string,b:array<double>,p:int>>>"
FINDING = ["doc_id", "family", "severity", "r", "c", "message"]


def payload_of(raw: Column) -> Column:
    """The payload in a model's answer; null if there is none that parses. A field of a wrong type is null."""
    some = lambda p: p["columns"].isNotNull() | p["cells"].isNotNull() | p["ignored"].isNotNull() | p["ocr_missed"].isNotNull()
    return once(F.from_json(outer_json(raw, "cells"), PAYLOAD), lambda p: F.when(some(p), p))


def with_payload(answers: DataFrame) -> DataFrame:
    """answers (with raw) that hold a payload, with it. It comes from a generator, behind which the engine does not parse again for filters and fields."""
    return answers.select("*", F.explode(F.array(payload_of(F.col("raw")))).alias("payload")).where("payload is not null")


def cells(payloads: DataFrame, *keys: str) -> DataFrame:
    """(keys, ord, r, c, rs, cs, h, t, b, p, f) of (keys, payload); spans default to 1."""
    keys = keys or ("doc_id",)
    each = payloads.select(*keys, F.posexplode("payload.cells").alias("ord", "e")).where("e is not null").select(*keys, "ord", "e.*")
    return each.withColumn("rs", F.coalesce("rs", F.lit(1))).withColumn("cs", F.coalesce("cs", F.lit(1)))


def _sane(c: DataFrame) -> DataFrame:
    """cells with positions and spans made usable: at least 0 and 1, at the origin if one is missing."""
    bad = F.col("r").isNull() | F.col("c").isNull()
    at = lambda n, low: F.when(bad, low).otherwise(F.greatest(F.col(n), F.lit(low)))
    return c.withColumns({"r": at("r", 0), "c": at("c", 0), "rs": at("rs", 1), "cs": at("cs", 1)})


def positions(c: DataFrame, *keys: str) -> DataFrame:
    """A row for each grid position that a cell covers: y, x."""
    ys, xs = F.sequence(F.col("r"), F.col("r") + F.col("rs") - 1), F.sequence(F.col("c"), F.col("c") + F.col("cs") - 1)
    return c.withColumn("y", F.explode(ys)).withColumn("x", F.explode(xs))


def occupancy(c: DataFrame) -> DataFrame:
    """The cells that stand in the grid: by (r, c, ord), a cell stands if no standing one covers its corner."""

    def fold(rows: Rows, at: np.ndarray) -> tuple[np.ndarray, Rows]:
        r, c_, rs, cs, ord_ = (np.asarray(rows[n]).astype(np.int64) for n in ("r", "c", "rs", "cs", "ord"))
        order = np.lexsort((ord_, c_, r, np.repeat(np.arange(len(at) - 1), np.diff(at))))
        stand = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            # Rows come from the top: a standing cell is over a corner if it has the column and ends below.
            above: list[tuple[int, int, int]] = []
            row = -1
            for i in order[a:b].tolist():
                y, x = r[i], c_[i]
                if y > row:
                    above, row = [s for s in above if s[2] > y], y
                if not any(low <= x < high for low, high, _ in above):
                    above.append((x, x + cs[i], y + rs[i]))
                    stand.append(i)
        return np.array(stand, np.int64), {}

    return by_page(_sane(c), ["doc_id"], fold)


def dims(payloads: DataFrame, c: DataFrame) -> DataFrame:
    """(doc_id, n_rows, n_cols): what cells and declared columns reach."""
    own = _sane(c).groupBy("doc_id").agg(F.max(F.col("r") + F.col("rs")).alias("n_rows"), F.max(F.col("c") + F.col("cs")).alias("n_c"))
    declared = payloads.select("doc_id", F.greatest(F.size(F.coalesce("payload.columns", F.array().cast("array<struct<name:string,kind:string>>"))), F.lit(0)).alias("n_d"))
    return declared.join(own, "doc_id", "left").select("doc_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.greatest("n_d", F.coalesce("n_c", F.lit(0))).alias("n_cols"))


def holes(standing: DataFrame, dim: DataFrame) -> DataFrame:
    """(doc_id, y, x): grid positions that no cell covers, which are blank and stay so."""
    every = dim.where("n_rows > 0 and n_cols > 0").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    return every.join(positions(standing).select("doc_id", "y", "x"), ["doc_id", "y", "x"], "left_anti").select("doc_id", "y", "x")


def _found(df: DataFrame, family: str, message: Column, r: Column | None = None, c: Column | None = None, severity: str = "problem") -> DataFrame:
    none = F.lit(None).cast("int")
    return df.select("doc_id", F.lit(family).alias("family"), F.lit(severity).alias("severity"), (none if r is None else r).cast("int").alias("r"), (none if c is None else c).cast("int").alias("c"), message.alias("message"))


def _label() -> Column:
    show = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("None"))
    return F.concat(F.lit("cell r="), show("r"), F.lit(" c="), show("c"), F.lit(" '"), F.substring(norm(F.coalesce("t", F.lit(""))), 1, 30), F.lit("'"))


def overlaps(c: DataFrame) -> DataFrame:
    """(doc_id, ord, r, c, y, x, by): positions that an earlier cell of the list has claimed."""
    w = Window.partitionBy("doc_id", "y", "x").orderBy("ord")
    at = positions(c.where("r >= 0 and c >= 0 and rs >= 1 and cs >= 1"))
    return at.withColumn("n", F.row_number().over(w)).withColumn("by", F.first("ord").over(w)).where("n > 1").select("doc_id", "ord", "r", "c", "y", "x", "by")


def validate(payloads: DataFrame, n_pages: int | DataFrame = 1, grounded: bool = False) -> DataFrame:
    return reduce(DataFrame.unionByName, validations(payloads, n_pages, grounded))


def validations(payloads: DataFrame, n_pages: int | DataFrame = 1, grounded: bool = False) -> list[DataFrame]:
    """Findings on shape, positions, overlaps, texts, boxes and pages of (doc_id, payload).

    n_pages: of all documents, or (doc_id, n_pages) of each, 1 where it has none. grounded: cells that cite fragments need no text, box or page of their own.
    """
    p = F.col("payload")
    shape = F.when(p.isNull(), "the output is no object with columns and cells").when(F.coalesce(F.size(p["columns"]), F.lit(0)) < 1, "columns are missing").when(F.coalesce(F.size(p["cells"]), F.lit(0)) < 1, "cells are missing")
    broken = payloads.withColumn("m", shape)
    out = [_found(broken.where("m is not null"), "structure", F.col("m"))]
    whole = broken.where("m is null").drop("m").withColumn("n_cols", F.size("payload.columns"))
    whole = whole.withColumn("n_pages", F.lit(n_pages)) if isinstance(n_pages, int) else whole.join(n_pages.select("doc_id", "n_pages"), "doc_id", "left").fillna(1, ["n_pages"])
    c = cells(whole, "doc_id", "n_cols", "n_pages")
    r_, c_ = F.col("r"), F.col("c")
    good = F.col("r").isNotNull() & F.col("c").isNotNull()
    legal = good & (F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("rs") >= 1) & (F.col("cs") >= 1)
    own = legal & ~(F.coalesce(F.size("f"), F.lit(0)) > 0) if grounded else legal
    say = lambda text: F.concat(_label(), F.lit(f": {text}"))
    b = F.col("b")
    four = F.coalesce((F.size(b) == 4) & ~F.exists(b, lambda v: v.isNull()), F.lit(False))
    # All that is wrong with a cell is said in one pass over the cells: a branch for each would read them as often.
    wrong = [
        F.when(~good, say("position and spans have to be whole numbers")),
        F.when(good & ~legal, say("a negative position or a span below 1")),
        F.when(legal & (F.col("c") + F.col("cs") > F.col("n_cols")), F.concat(_label(), F.lit(": reaches past the "), F.col("n_cols").cast("string"), F.lit(" declared columns"))),
        F.when(own & (norm(F.coalesce("t", F.lit(""))) == ""), say("no text; blank cells are left out")),
        F.when(own & ~four, say("the box is not four numbers")),
        F.when(own & four & ((b[2] <= b[0]) | (b[3] <= b[1])), say("the box has no area")),
        F.when(own & F.coalesce((F.col("p") < 1) | (F.col("p") > F.col("n_pages")), F.lit(True)), F.concat(say("the page is outside 1.."), F.col("n_pages").cast("string"))),
    ]
    said = c.select("doc_id", "r", "c", F.explode(F.filter(F.array(*wrong), lambda m: m.isNotNull())).alias("m"))
    out.append(_found(said, "structure", F.col("m"), r_, c_))
    over = overlaps(c.where(legal).drop("n_cols", "n_pages"))
    out.append(_found(over, "structure", F.format_string("cell r=%d c=%d: position (%d, %d) is taken by cell number %d", "r", "c", "y", "x", "by"), r_, c_))
    return out


def identity(payloads: DataFrame, fragments: DataFrame) -> DataFrame:
    """Findings where a fragment is not accounted for exactly once: cited by one cell, or ignored.

    fragments: (doc_id, id, text). Kinds: uncited cell, invented, duplicated, ignored unknown, ignored but
    used, dropped. What cites, ignores and is a fragment meets in one grouping by document and id.
    """
    none = lambda t: F.lit(None).cast(t)
    kind = dict(fragments.dtypes)["id"]
    event = lambda what, fid, ord_, pos, r, c, text: F.struct(F.lit(what).alias("what"), fid.cast(kind).alias("fid"), ord_.alias("ord"), pos.alias("pos"), r.alias("r"), c.alias("c"), text.alias("text"))
    at = lambda e, i, what, fid, pos: event(what, fid, i, pos, e["r"], e["c"], none("string"))
    cited = lambda e, i: F.when(F.coalesce(F.size(e["f"]), F.lit(0)) < 1, F.array(at(e, i, "uncited", none(kind), F.lit(0)))).otherwise(F.transform(e["f"], lambda f, k: at(e, i, "cited", f, k)))
    bare = lambda what, fid, text=none("string"): event(what, fid, F.lit(0), F.lit(0), none("int"), none("int"), text)
    cells_ = F.flatten(F.transform(F.coalesce("payload.cells", F.array().cast(f"array<{CELL}>")), lambda e, i: F.when(e.isNull(), F.array().cast(f"array<struct<what:string,fid:{kind},ord:int,pos:int,r:int,c:int,text:string>>")).otherwise(cited(e, i))))
    ignored = F.transform(F.coalesce("payload.ignored", F.array().cast("array<int>")), lambda f: bare("ignored", f))
    own = payloads.select("doc_id", F.explode(F.concat(F.array(bare("payload", none(kind))), cells_, ignored)).alias("e"))
    both = own.unionByName(fragments.select("doc_id", bare("fragment", F.col("id"), F.col("text")).alias("e"))).select("doc_id", "e.*")
    both = both.withColumn("whole", F.max((F.col("what") == "payload") & F.col("doc_id").isNotNull()).over(Window.partitionBy("doc_id")))
    met = Window.partitionBy("doc_id", "fid")
    there = lambda what: F.coalesce(F.max((F.col("what") == what) & F.col("doc_id").isNotNull() & F.col("fid").isNotNull()).over(met), F.lit(False))
    both = both.withColumns({k: there(k) for k in ("fragment", "cited", "ignored")})
    place = F.row_number().over(Window.partitionBy("doc_id", "fid", "what").orderBy("ord", "pos"))
    both = both.withColumn("n", place)
    cell = lambda *parts: F.concat(F.format_string("cell r=%d c=%d: ", "r", "c"), *parts)
    fid, what = F.col("fid").cast("string"), F.col("what")
    message = (
        F.when(what == "uncited", cell(F.lit("cites no fragment")))
        .when(what == "cited", F.when(~F.col("fragment"), cell(F.lit("cites unknown fragment "), fid, F.lit(" (invented)"))).when(F.col("n") > 1, cell(F.lit("fragment "), fid, F.lit(" is cited before (duplicated)"))))
        .when((what == "fragment") & F.col("whole") & ~(F.col("cited") | F.col("ignored")), F.concat(F.lit("fragment "), fid, F.lit(" '"), F.substring(norm(F.col("text")), 1, 40), F.lit("' is neither used nor ignored (dropped)")))
    )
    used = F.when(~F.col("fragment"), F.concat(F.lit("ignored lists unknown fragment "), fid)).when(F.col("cited"), F.concat(F.lit("fragment "), fid, F.lit(" is both used and ignored")))
    wrong = (what == "uncited") | ((what == "cited") & (~F.col("fragment") | (F.col("n") > 1))) | ((what == "ignored") & (~F.col("fragment") | F.col("cited"))) | ((what == "fragment") & F.col("whole") & ~(F.col("cited") | F.col("ignored")))
    found = both.where(wrong).withColumn("message", F.when(what == "ignored", used).otherwise(message))
    return _found(found, "identity", F.col("message"), F.col("r"), F.col("c"))


def word_bag(payloads: DataFrame, words: DataFrame) -> DataFrame:
    """Findings by text alone: OCR texts in no cell (dropped), cell words in no OCR text (invented)."""
    joined = cells(payloads).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", norm(F.coalesce("t", F.lit(""))).alias("t")))), lambda e: e["t"]), " ").alias("joined"))
    texts = words.select("doc_id", norm(F.col("text")).alias("t")).where("t <> ''")
    lost = texts.join(joined, "doc_id").where(~F.contains("joined", "t"))
    bag = F.filter(F.array_distinct(F.flatten(F.collect_list(F.split("t", " ")))), lambda x: x != "")
    bags = texts.groupBy("doc_id").agg(bag.alias("bag"))
    tokens = F.filter(F.array_distinct(F.split("joined", " ")), lambda x: x != "")
    made = joined.join(bags, "doc_id").withColumn("token", F.explode(F.array_sort(F.array_except(tokens, "bag"))))
    return _found(lost, "words", F.concat(F.lit("text '"), F.substring("t", 1, 40), F.lit("' is in no cell (dropped)"))).unionByName(_found(made, "words", F.concat(F.lit("word '"), F.substring("token", 1, 40), F.lit("' is in no text read (invented)"))))


def filled(c: DataFrame, fragments: DataFrame) -> DataFrame:
    """cells with text, box and page from the fragments that they cite, left to right; a text that is there
    stays, unknown ids are passed over, a cell of unknown ids only is left as it is."""
    refs = c.select("doc_id", "ord", F.posexplode("f").alias("pos", "id"))
    of = met(refs, fragments.select("doc_id", "id", "text", "x", "y", "w", "h", "page"), ["doc_id", "id"])
    own = of.groupBy("doc_id", "ord").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "pos", "text"))), lambda e: e["text"]), " ").alias("_t"),
        F.array(F.min("x"), F.min("y"), F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))).cast("array<double>").alias("_b"),
        F.min_by("page", F.struct("x", "pos")).cast("int").alias("_p"),
    )
    out = met(c, own, ["doc_id", "ord"], "left")
    blank = norm(F.coalesce("t", F.lit(""))) == ""
    return out.withColumn("t", F.when(F.col("_t").isNotNull() & blank, F.col("_t")).otherwise(F.col("t"))).withColumn("b", F.coalesce("_b", "b")).withColumn("p", F.coalesce("_p", "p")).drop("_t", "_b", "_p").select(*c.columns)


def content_key(c: DataFrame) -> Column:
    """What a cell holds, for voting: its fragments, else its text without case."""
    cited = F.coalesce(F.size("f"), F.lit(0)) > 0
    return F.when(cited, F.concat(F.lit("f:"), F.array_join(F.transform("f", lambda x: x.cast("string")), ","))).otherwise(F.concat(F.lit("t:"), folded(F.coalesce("t", F.lit("")))))


def vote(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells with votes and confidence, columns) of (doc_id, draft, payload): what most drafts agree on.

    A position stays if more than half of the drafts with cells fill it; of its contents the most frequent
    wins, the first seen among equals. Each draft has one vote a position.
    """
    some = drafts.where(F.coalesce(F.size("payload.cells"), F.lit(0)) > 0)
    # k goes along with the rows: a join on it would deal all drafts out once more.
    k = some.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    c = cells(k, "doc_id", "k", "draft").where("r is not null and c is not null")
    first = c.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "draft", "r", "c").orderBy("ord"))).where("n = 1").drop("n")
    first = first.withColumn("key", content_key(first))
    entry = F.struct("draft", "ord", "rs", "cs", "h", "t", "b", "p", "f")
    counted = first.groupBy("doc_id", "k", "r", "c", "key").agg(F.count(F.lit(1)).alias("votes"), F.min_by(entry, F.struct("draft", "ord")).alias("cell"))
    anchor = counted.groupBy("doc_id", "k", "r", "c").agg(F.sum("votes").alias("entries"), F.min_by(F.struct("votes", "cell"), F.struct(-F.col("votes"), F.col("cell.draft"), F.col("cell.ord"))).alias("best"))
    won = anchor.where("2 * entries > k")
    out = won.select("doc_id", "r", "c", "best.cell.rs", "best.cell.cs", "best.cell.h", "best.cell.t", "best.cell.b", "best.cell.p", "best.cell.f", F.col("best.votes").alias("votes"), (F.col("best.votes") / F.col("k")).alias("confidence"))
    out = out.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("r", "c")) - 1)
    columns = plurality(some.withColumn("columns", F.col("payload.columns")), ["doc_id"], "columns", "draft", "columns")
    return out, columns


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _written(cell: dict[str, pa.Array], at: np.ndarray, declared: list[int]) -> Iterator[str]:
    """Each document's table, of its cells' places, spans and written parts."""
    r, c, rs, cs, p = (np.asarray(cell[n]) for n in ("r", "c", "rs", "cs", "p"))
    order = np.lexsort((c, r, np.repeat(np.arange(len(at) - 1), np.diff(at)))).tolist()
    bottom, right = r.astype(np.int64) + rs, c.astype(np.int64) + cs
    r, c, rs, cs = r.tolist(), c.tolist(), rs.tolist(), cs.tolist()
    before, page, rest = (cell[n].to_pylist() for n in ("before", "page", "rest"))
    for a, b, n in zip(at[:-1].tolist(), at[1:].tolist(), declared, strict=True):
        if a == b:
            yield ""
            continue
        many = p[a:b].max() > 1
        width = max(n, int(right[a:b].max()))
        grid = [[None] * width for _ in range(int(bottom[a:b].max()))]
        for i in order[a:b]:
            row, x = grid[r[i]], c[i]
            if row[x] is None:  # else a standing cell covers its corner
                if rs[i] > 1 or cs[i] > 1:
                    for below in grid[r[i] : r[i] + rs[i]]:
                        below[x : x + cs[i]] = ["" if s is None else s for s in below[x : x + cs[i]]]
                row[x] = before[i] + (page[i] if many else "") + rest[i]
        yield "<table>" + "".join("<tr>" + "".join("<td></td>" if s is None else s for s in row) + "</tr>" for row in grid) + "</table>"


def html(payloads: DataFrame, c: DataFrame | None = None) -> DataFrame:
    """(doc_id, html) of (doc_id, payload): cells with spans, boxes and pages, blanks as empty cells.

    The first cell to claim a position stands; pages are written if any cell is past the first. c: the cells, where
    they are not the payload's; else a payload's own list is written as it is, and nothing is dealt out.
    """
    attr = lambda name, v: F.when(v > 1, F.concat(F.lit(f' {name}="'), v.cast("string"), F.lit('"'))).otherwise("")

    def part(e: Column) -> Column:
        bad = e["r"].isNull() | e["c"].isNull()
        at = lambda n, low: F.when(bad, low).otherwise(F.greatest(e[n], F.lit(low)))
        r, c_, rs, cs = at("r", 0), at("c", 0), at("rs", 1), at("cs", 1)
        four = F.coalesce((F.size(e["b"]) == 4) & ~F.exists(e["b"], lambda v: v.isNull()), F.lit(False))
        box = F.when(four, F.concat(F.lit(' data-bbox="'), F.array_join(F.transform(e["b"], lambda v: F.bround(v).cast("long").cast("string")), ","), F.lit('"'))).otherwise("")
        page = F.when(e["p"].isNotNull(), F.concat(F.lit(' data-page="'), e["p"].cast("string"), F.lit('"'))).otherwise("")
        tag = F.when(F.coalesce(e["h"], F.lit(False)), "th").otherwise("td")
        before = F.concat(F.lit("<"), tag, attr("rowspan", rs), attr("colspan", cs), box)
        rest = F.concat(F.lit(">"), _escaped(norm(F.coalesce(e["t"], F.lit("")))), F.lit("</"), tag, F.lit(">"))
        return F.struct(r.alias("r"), c_.alias("c"), rs.alias("rs"), cs.alias("cs"), F.coalesce(e["p"], F.lit(1)).alias("p"), before.alias("before"), page.alias("page"), rest.alias("rest"))

    n = F.coalesce(F.size("payload.columns"), F.lit(0)).alias("n")
    if c is None:
        lists = payloads.select("doc_id", n, F.filter("payload.cells", lambda e: e.isNotNull()).alias("cells"))
    else:
        item = F.struct("ord", F.struct("r", "c", "rs", "cs", "h", "t", "b", "p").alias("e"))
        own = c.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("cells"))
        lists = payloads.select("doc_id", n).join(own, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                items = batch.column("parts")
                at = np.asarray(items.offsets).astype(np.int64)
                flat = items.values.slice(at[0], at[-1] - at[0])
                cell = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
                made = pa.array(_written(cell, at - at[0], np.maximum(np.asarray(batch.column("n")), 0).tolist()), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), made], ["doc_id", "html"])

    parts = F.coalesce(F.transform("cells", part), F.transform(F.array().cast(f"array<{CELL}>"), part))
    kind = dict(payloads.dtypes)["doc_id"]
    return lists.select("doc_id", "n", parts.alias("parts")).mapInArrow(run, f"doc_id {kind}, html string")


def missed(payloads: DataFrame) -> DataFrame:
    """(doc_id, t, b, p): text that a model says the reading pass missed."""
    return payloads.select("doc_id", F.explode("payload.ocr_missed").alias("m")).where("m is not null").select("doc_id", "m.*")
