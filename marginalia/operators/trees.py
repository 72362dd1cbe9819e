"""Structure trees of any depth: what lies below an element, what it takes from above, and its place in reading order.

A document of SMALL elements at most is a row with them as an array, and its tree is worked out in that row. Larger ones are walked by rows:
Pointers to parents are doubled: after k rounds a row knows its 2^k-th ancestor, so a chain of 5,000 elements takes 13 rounds
of joins on (document, element), and no round has more rows than there are elements. Sums over all that lies below need no
pairs either: a distance has one form in powers of two, so each row's total reaches every ancestor once.

An element whose parent is missing is a root. Elements that are their own ancestors have no place in a tree and are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.dialect import SPARK, Spark
from marginalia.sources.files import saved

from .base import built, squeeze, view

Pull = Callable[[Column, Column], Column]


def climbed(nodes: DataFrame, pulls: dict[str, Pull], sums: tuple[str, ...] = (), levels: int | None = None) -> DataFrame:
    """Nodes (doc_id, node, up, ..) with their columns carried through the tree. ``pulls``: how a value and that of the row above
    become one; ``sums``: columns added up over all that lies below, itself included. ``levels``: how many levels count, itself
    included, a power of two. Rows on or below a ring come back with ``up`` not null, all others with null."""
    rows, left, seen = nodes, None, 1
    while levels is None or seen < levels:
        above = rows.select(F.col("doc_id").alias("a_doc"), F.col("node").alias("a_node"), F.col("up").alias("a_up"), *[F.col(c).alias(f"a_{c}") for c in pulls])
        met = rows.join(above, (F.col("doc_id") == F.col("a_doc")) & (F.col("up") == F.col("a_node")), "left")
        if sums:
            added = rows.filter("up is not null").groupBy(F.col("doc_id").alias("s_doc"), F.col("up").alias("s_node")).agg(*[F.sum(c).alias(f"s_{c}") for c in sums])
            met = met.join(added, (F.col("doc_id") == F.col("s_doc")) & (F.col("node") == F.col("s_node")), "left")
        carried = {c: F.when(F.col("a_node").isNull(), F.col(c)).otherwise(f(F.col(c), F.col(f"a_{c}"))) for c, f in pulls.items()}
        carried |= {c: F.col(c) + F.coalesce(F.col(f"s_{c}"), F.lit(0)) for c in sums}
        rows = saved(met.select(*[F.col("a_up").alias("up") if c == "up" else carried.get(c, F.col(c)).alias(c) for c in nodes.columns]))
        seen *= 2
        before, left = left, rows.filter("up is not null").count()
        if not left or left == before:
            break
    return rows


def _nodes(elems: DataFrame) -> DataFrame:
    """(doc_id, node, up, kind, own_page): one row an element, parents that are not there as none."""
    one = elems.groupBy("doc_id", F.col("elem_id").alias("node")).agg(F.min(F.struct("parent_id", "kind", "page")).alias("e")).select("doc_id", "node", "e.*")
    there = elems.select(F.col("doc_id").alias("p_doc"), F.col("elem_id").alias("p_elem")).distinct()
    return one.join(there, (F.col("doc_id") == F.col("p_doc")) & (F.col("parent_id") == F.col("p_elem")), "left").select("doc_id", "node", F.col("p_elem").alias("up"), "kind", F.col("page").alias("own_page"))


#: Elements of a document that is worked out in one row; larger documents go through rounds of joins.
SMALL = 128


def let(name: str, value: str, body: str) -> str:
    """The body with a name for a value that is worked out once. (``get`` asks for the types of all it holds again in every row.)"""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def by_document(rows: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, n, items): the rows of a small document as one array in order of the columns; of a larger one (n over SMALL), or one without
    an id, a row each. n is the number of rows of the document."""
    row, n, item = F.struct(*columns), F.count("*").over(Window.partitionBy("doc_id")), F.col("item")
    counted = rows.select("doc_id", row.alias("item"), F.when(F.col("doc_id").isNull(), F.lit(SMALL + 1)).otherwise(n).alias("n"))
    alone = F.when(F.col("n") > SMALL, F.monotonically_increasing_id())
    return counted.withColumn("alone", alone).groupBy("doc_id", "n", "alone").agg(F.sort_array(F.collect_list(item)).alias("items")).drop("alone")


#: The way to the root by doubling, for arrays: each element's place above it (from 1 on, 0 for none), and what it gathers.
_CLIMB = """aggregate(sequence(1, 1 + cast(ceil(log2(size(up) + 1)) as int)), named_struct('up', up, 'page', pages, 'path', paths), (s, k) -> named_struct(
  'up', transform(s.up, u -> case when u = 0 then 0 else s.up[u - 1] end),
  'page', transform(s.page, (x, i) -> case when x is null and s.up[i] > 0 then s.page[s.up[i] - 1] else x end),
  'path', transform(s.path, (x, i) -> case when s.up[i] > 0 then concat(s.path[s.up[i] - 1], x) else x end)))"""


def _walked() -> str:
    """The elements of a small document in reading order, with all that elem_docs gives."""
    first = "filter(items, (x, i) -> i = 0 or not (x.elem_id <=> items[i - 1].elem_id))"
    rooted = """transform(sort_array(filter(transform(c.path, (p, i) -> named_struct('path', p, 'i', i, 'ring', c.up[i] > 0)), x -> not x.ring)), x -> named_struct('at', x.i, 'depth', size(x.path) - 1))"""
    leave = "coalesce(array_min(transform(o, (y, j) -> case when j > e and y.depth <= x.depth then j end)), size(o))"
    one = """named_struct('elem_id', nodes[x.at].elem_id, 'parent_id', case when up[x.at] > 0 then nodes[up[x.at] - 1].elem_id end, 'kind', nodes[x.at].kind, 'own_page', nodes[x.at].page, 'page', c.page[x.at],
      'depth', cast(x.depth as bigint), 'size', cast(leave - e as bigint), 'headers', cast(size(filter(slice(o, e + 1, leave - e), y -> nodes[y.at].kind = '/TH')) as bigint), 'enter', cast(e as bigint))"""
    each = f"transform(o, (x, e) -> {let('leave', leave, one)})"
    climbed_ = let("pages", "transform(nodes, x -> x.page)", let("paths", "transform(nodes, (x, i) -> array(i))", _CLIMB))
    with_order = let("c", climbed_, let("o", rooted, each))
    return let("nodes", first, let("ids", "transform(nodes, x -> x.elem_id)", let("up", "transform(nodes, x -> cast(coalesce(array_position(ids, x.parent_id), 0) as int))", with_order)))


@built("fx_elems")
def elem_docs(fx_elems: DataFrame) -> DataFrame:
    """(doc_id, n, items): the elements that have a place in their document's tree, a row with all of them for a small document (n up to
    SMALL) and a row each for others: elem_id, parent_id, kind, own_page, page (its own or that of its nearest ancestor that has one), depth,
    size and headers (how many elements and header cells it holds, itself included) and enter, its place in reading order."""
    docs = by_document(fx_elems, "elem_id", "parent_id", "kind", "page")
    null = f"transform(items, x -> named_struct('elem_id', x.elem_id, 'parent_id', x.parent_id, 'kind', x.kind, 'own_page', x.page, 'page', x.page, 'depth', 0L, 'size', 0L, 'headers', 0L, 'enter', 0L))"
    docs = saved(docs.select("doc_id", "n", F.expr(f"case when n <= {SMALL} then {_walked()} else {null} end").alias("items")))
    small, large = docs.filter(F.col("n") <= SMALL), docs.filter(F.col("n") > SMALL)
    if large.isEmpty():
        return small
    columns = "elem_id parent_id kind own_page page depth size headers enter".split()
    rows = _ordered(_totals(large.select("doc_id", F.inline("items")).select("doc_id", "elem_id", "parent_id", "kind", F.col("own_page").alias("page"))))
    return small.unionByName(rows.select("doc_id", F.lit(SMALL + 1).cast("long").alias("n"), F.array(F.struct(*columns)).alias("items")).select("doc_id", "n", F.col("items").cast(small.schema["items"].dataType).alias("items")))


def _totals(elems: DataFrame) -> DataFrame:
    """What elem_docs gives but the place, of documents of any size, by rounds of joins."""
    nodes = saved(_nodes(elems).withColumns({"page": F.col("own_page"), "depth": F.col("up").isNotNull().cast("long"), "size": F.lit(1).cast("long"), "headers": (F.col("kind") == "/TH").cast("long"), "parent_id": F.col("up")}))
    rows = climbed(nodes, {"page": lambda own, above: F.coalesce(own, above), "depth": lambda own, above: own + above}, ("size", "headers"))
    return rows.filter("up is null").withColumnRenamed("node", "elem_id").drop("up")


def _ordered(totals: DataFrame) -> DataFrame:
    """The totals with ``enter``."""
    before = F.sum("size").over(Window.partitionBy("doc_id", "parent_id").orderBy("elem_id").rowsBetween(Window.unboundedPreceding, -1))
    step = F.coalesce(before, F.lit(0)) + F.when(F.col("parent_id").isNull(), 0).otherwise(1)
    nodes = totals.withColumns({"up": F.col("parent_id"), "enter": step.cast("long")}).withColumnRenamed("elem_id", "node")
    return climbed(saved(nodes), {"enter": lambda own, above: own + above}).withColumnRenamed("node", "elem_id").drop("up")


@view
def elem_totals(d: Spark) -> str:
    """(doc_id, elem_id, parent_id, kind, own_page, page, depth, size, headers) of every element."""
    return totals_by_pairs(d) if d.name == "duck" else "select doc_id, x.elem_id, x.parent_id, x.kind, x.own_page, x.page, x.depth, x.size, x.headers from (select doc_id, explode(items) x from elem_docs) e"


@view
def elem_order(d: Spark) -> str:
    """The totals with ``enter`` and ``leave``: an element's place in reading order, and that of the first element after all it holds."""
    return order_by_paths(d) if d.name == "duck" else "select doc_id, x.elem_id, x.parent_id, x.kind, x.own_page, x.page, x.depth, x.size, x.headers, x.enter, x.enter + x.size leave from (select doc_id, explode(items) x from elem_docs) e"


@view
def elem_walk(d: Spark) -> str:
    """The check of the trees walks them from their roots down, each element with the path of elements that leads to it."""
    return """select e.doc_id, e.elem_id, p.elem_id parent_id, e.kind, e.page own_page, e.page, 0 depth, [e.elem_id] path from fx_elems e left join fx_elems p on p.doc_id = e.doc_id and p.elem_id = e.parent_id where p.elem_id is null
      union all select e.doc_id, e.elem_id, e.parent_id, e.kind, e.page, coalesce(e.page, w.page), w.depth + 1, list_append(w.path, e.elem_id) from fx_elems e join elem_walk w on w.doc_id = e.doc_id and w.elem_id = e.parent_id"""


@view
def elem_pairs(d: Spark) -> str:
    """(doc_id, top, elem_id, kind): the check's pairs of an element and all that it holds, itself included."""
    return "select doc_id, unnest(path) top, elem_id, kind from elem_walk"


def totals_by_pairs(d: Spark) -> str:
    return """select w.doc_id, w.elem_id, w.parent_id, w.kind, w.own_page, w.page, w.depth, t.size, t.headers from elem_walk w
      join (select doc_id, top, count(*) size, count_if(kind = '/TH') headers from elem_pairs group by doc_id, top) t on t.doc_id = w.doc_id and t.top = w.elem_id"""


def order_by_paths(d: Spark) -> str:
    return """select o.*, o.enter + t.size leave from (select *, row_number() over (partition by doc_id order by path) - 1 enter from elem_walk) o
      join (select doc_id, top, count(*) size from elem_pairs group by doc_id, top) t on t.doc_id = o.doc_id and t.top = o.elem_id"""


@view
def held_pieces(d: Spark) -> str:
    """(doc_id, elem_id, kind, enter, page, mcid, text): every element with the marked content that it holds, through all descendants.

    Which elements hold a place is a question of ranges; both sides are cut into blocks of powers of two, a range into at most two
    a size and a place into one a size, so that they meet by equality and each pair once.
    """
    if d.name == "duck":
        return "select p.doc_id, p.top elem_id, o.enter, c.page, c.mcid, c.text from elem_pairs p join fx_content c on c.doc_id = p.doc_id and c.elem_id = p.elem_id join elem_order o on o.doc_id = c.doc_id and o.elem_id = c.elem_id"
    low, high = "shiftright(enter + shiftleft(1L, l) - 1, l)", "shiftright(leave, l)"
    block = lambda at, odd: f"case when {low} < {high} and {odd} % 2 = 1 then named_struct('l', l, 'b', {at}) end"
    return f"""select e.doc_id, e.elem_id, e.kind, c.enter, c.page, c.mcid, c.text from
        (select doc_id, elem_id, kind, x.l, x.b from (select doc_id, elem_id, kind, explode(flatten(transform(sequence(0, cast(ceil(log2(leave + 1)) as int)), l -> array_compact(array({block(low, low)}, {block(f'{high} - 1', high)}))))) x from elem_order) r) e
      join (select doc_id, enter, page, mcid, text, l, shiftright(enter, l) b from (select doc_id, enter, page, mcid, text, explode(sequence(0, cast(ceil(log2(places + 1)) as int))) l from
        (select o.doc_id, o.enter, o.places, c.page, c.mcid, c.text from (select doc_id, elem_id, enter, max(leave) over (partition by doc_id) places from elem_order) o join fx_content c on c.doc_id = o.doc_id and c.elem_id = o.elem_id) p) q) c
      on c.doc_id = e.doc_id and c.l = e.l and c.b = e.b"""


@built("elem_docs", "fx_content")
def texts_below(elem_docs: DataFrame, fx_content: DataFrame) -> DataFrame:
    """(doc_id, elem_id, kind, text): all marked content of an element and its descendants, in the order of the tree. Where elements and
    pieces of a document are few, its row holds both; others meet piece by piece (held_pieces)."""
    content = saved(by_document(fx_content, "elem_id", "page", "mcid", "text"))
    place = "elems[cast(array_position(ids, p.elem_id) as int) - 1].enter"
    placed = f"sort_array(transform(filter(pieces, p -> array_contains(ids, p.elem_id)), p -> named_struct('enter', {place}, 'page', p.page, 'mcid', p.mcid, 'text', p.text)))"
    held = "transform(filter(placed, p -> p.enter >= e.enter and p.enter < e.enter + e.size), p -> p.text)"
    each = f"filter(transform(elems, e -> named_struct('elem_id', e.elem_id, 'kind', e.kind, 'held', {held})), x -> size(x.held) > 0)"
    both = elem_docs.filter(F.col("n") <= SMALL).selectExpr("doc_id", "items elems").join(content.filter(F.col("n") <= SMALL).selectExpr("doc_id", "items pieces"), "doc_id")
    whole = both.select("doc_id", F.explode(F.expr(let("ids", "transform(elems, e -> e.elem_id)", let("placed", placed, each)))).alias("x"))
    text = f"case when size(array_compact(x.held)) > 0 then {squeeze(SPARK, "array_join(x.held, ' ')")} end"
    texts = whole.selectExpr("doc_id", "x.elem_id", "x.kind", f"{text} text")
    large = elem_docs.filter(F.col("n") > SMALL).select("doc_id").union(content.filter(F.col("n") > SMALL).select("doc_id")).distinct()
    if large.isEmpty():
        return texts
    rows = elem_docs.join(large, "doc_id", "left_semi").select("doc_id", F.inline("items")).withColumn("leave", F.col("enter") + F.col("size"))
    named = held_pieces(SPARK).replace("from elem_order", "from {elem_order}").replace("join fx_content", "join {fx_content}")
    pieces = elem_docs.sparkSession.sql(named, elem_order=rows, fx_content=content.join(large, "doc_id", "left_semi").select("doc_id", F.inline("items")))
    return texts.union(pieces.groupBy("doc_id", "elem_id", "kind").agg(F.expr(f"{squeeze(SPARK, SPARK.join('text', ' ', 'enter, page, mcid'))} text")))


texts_below.check = lambda d: f"select doc_id, elem_id, {squeeze(d, d.join('text', ' ', 'enter, page, mcid'))} text from held_pieces group by doc_id, elem_id"


@built("fx_annots")
def field_tips(fx_annots: DataFrame) -> DataFrame:
    """(doc_id, annot_id, named): widgets, and whether they or one of the seven above them have a tip."""
    named = (F.trim(F.coalesce("tip", F.lit(""))) != "").alias("named")
    docs = by_document(fx_annots.select("doc_id", "annot_id", "parent_id", "subtype", named), "annot_id", "parent_id", "subtype", "named")
    step = let("m", "filter(items, a -> array_contains(s.ups, a.annot_id))", "named_struct('ups', transform(m, a -> a.parent_id), 'hit', s.hit or exists(m, a -> a.named))")
    hit = let("m", "filter(items, a -> a.subtype = '/Widget' and a.annot_id <=> w)", f"aggregate(sequence(1, 7), named_struct('ups', transform(m, a -> a.parent_id), 'hit', exists(m, a -> a.named)), (s, k) -> {step}).hit")
    ids = "array_distinct(transform(filter(items, a -> a.subtype = '/Widget'), a -> a.annot_id))"
    widgets = f"transform({ids}, w -> named_struct('annot_id', w, 'parent_id', items[0].parent_id, 'subtype', '/Widget', 'named', {hit}))"
    docs = saved(docs.select("doc_id", "n", F.expr(f"case when n <= {SMALL} then {widgets} else items end").alias("items")))
    tips, large = docs.filter(F.col("n") <= SMALL).select("doc_id", F.inline("items")).select("doc_id", "annot_id", "named"), docs.filter(F.col("n") > SMALL)
    if large.isEmpty():
        return tips
    rows = climbed(large.select("doc_id", F.inline("items")).select("doc_id", F.col("annot_id").alias("node"), F.col("parent_id").alias("up"), "subtype", "named"), {"named": lambda own, above: own | above}, levels=8)
    return tips.union(rows.filter("subtype = '/Widget'").select("doc_id", F.col("node").alias("annot_id"), "named"))


@view
def field_walk(d: Spark) -> str:
    """(doc_id, annot_id, parent_id, tip, step): the check's widgets with their ancestors, eight levels counting itself."""
    return """select doc_id, annot_id, parent_id, tip, 0 step from fx_annots where subtype = '/Widget'
      union all select f.doc_id, f.annot_id, a.parent_id, a.tip, f.step + 1 from field_walk f join fx_annots a on a.doc_id = f.doc_id and a.annot_id = f.parent_id where f.step < 7"""


field_tips.check = lambda d: "select doc_id, annot_id, coalesce(bool_or(trim(tip) <> ''), false) named from field_walk group by doc_id, annot_id"
