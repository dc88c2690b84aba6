"""A schema's dependency graph: impact, lineage, waves, cycles, and differences between schemas.

An edge (src, dst, type) says that src needs dst. All operators take the edges as a DataFrame and work in rounds, a join
a level, each level written to storage: reach (least depths), waves (Kahn's layers) and cycles (what the layers leave).
Only the listing of every path with its risk enumerates paths, with a bound on their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lexer import Group, Token, tokenize, tree
from ..registry import MODEL, ORACLES, QUERIES, query, table
from ..sources.queries import describe, union
from ..storage import saved

#: Tables, views and procedures of the business model and what they need.
EDGES = [
    ("nation", "region", "REFERENCES"), ("customer", "nation", "REFERENCES"), ("supplier", "nation", "REFERENCES"), ("orders", "customer", "REFERENCES"), ("lineitem", "orders", "REFERENCES"),
    ("lineitem", "part", "REFERENCES"), ("lineitem", "supplier", "REFERENCES"), ("v_order_summary", "orders", "DEPENDS_ON"), ("v_order_summary", "customer", "DEPENDS_ON"), ("v_product_sales", "lineitem", "DEPENDS_ON"),
    ("v_product_sales", "part", "DEPENDS_ON"), ("v_dashboard", "v_order_summary", "DEPENDS_ON"), ("v_dashboard", "v_product_sales", "DEPENDS_ON"), ("p_create_order", "orders", "DEPENDS_ON"), ("p_cancel_order", "orders", "DEPENDS_ON"),
    ("p_nightly", "p_cancel_order", "CALLS"), ("p_nightly", "v_dashboard", "DEPENDS_ON"), ("p_report", "p_nightly", "CALLS"),
]
#: Column flows: from node and column to node and column.
FLOWS = [
    ("customer", "c_name", "v_order_summary", "full_name"), ("orders", "o_totalprice", "v_order_summary", "amount"), ("lineitem", "l_quantity", "v_product_sales", "sold"), ("lineitem", "l_extendedprice", "v_product_sales", "revenue"),
    ("v_order_summary", "amount", "v_dashboard", "orders_total"), ("v_product_sales", "revenue", "v_dashboard", "sales_total"), ("v_product_sales", "sold", "v_dashboard", "items"), ("v_dashboard", "sales_total", "p_report", "total"),
]


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + f") v({columns}))"


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "src string, dst string, type string")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def reachable(edges: DataFrame, start: DataFrame, max_depth: int = 1000, itself: bool = False) -> DataFrame:
    """(start, node, depth) of all that depends on the given nodes (column node), with the least depth; itself: also of a start that depends on itself."""
    seen = new = saved(edges.join(start, F.col("dst") == F.col("node")).select(F.col("dst").alias("start"), F.col("src").alias("node")).distinct().withColumn("depth", F.lit(1)), "graph-reach")
    for depth in range(2, max_depth + 1):
        step = new.join(edges, F.col("node") == F.col("dst")).select("start", F.col("src").alias("node")).distinct()
        new = saved(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "graph-reach")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen if itself else seen.where("node <> start")


def waves(edges: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(node, wave): 0 for what needs nothing, else one more than the latest wave of what it needs. Nodes on a cycle, or behind one, have none."""
    left, rest = saved(edges.select("src", "dst").distinct(), "graph-left"), saved(nodes(edges), "graph-nodes")
    done: list[DataFrame] = []
    for wave in range(max_depth):
        ready = saved(rest.join(left, F.col("node") == F.col("src"), "left_anti"), "graph-ready")
        if ready.isEmpty():
            break
        done.append(ready.withColumn("wave", F.lit(wave)))
        rest = saved(rest.join(ready, "node", "left_anti"), "graph-nodes")
        left = saved(left.join(ready.withColumnRenamed("node", "dst"), "dst", "left_anti"), "graph-left")
    return union(done) if done else rest.withColumn("wave", F.lit(0)).limit(0)


def cyclic(edges: DataFrame, max_depth: int = 1000) -> DataFrame:
    """The edges that can lie on a cycle: neither end falls away when layers are taken off from both sides."""
    left = saved(edges.select("src", "dst").distinct(), "graph-core")
    n = left.count()
    for _ in range(max_depth):
        inner = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = saved(inner.select("src", "dst"), "graph-core")
        n, before = left.count(), n
        if n in (0, before):
            break
    return left


def cycles(edges: DataFrame) -> DataFrame:
    """(start, node) where node depends on start, and start needs node itself."""
    core = cyclic(edges)
    closed = reachable(core, nodes(core), itself=True)
    return closed.join(core, (F.col("src") == F.col("start")) & (F.col("dst") == F.col("node"))).select("start", "node")


def paths(edges: DataFrame, start: DataFrame, max_depth: int = 12) -> DataFrame:
    """(start, node, depth, trail, types) of every simple path of at most max_depth steps that leads to what depends on start. Their number grows with the paths, not with the nodes."""
    now = edges.join(start, F.col("dst") == F.col("node")).select(F.col("dst").alias("start"), F.col("src").alias("node"), F.lit(1).alias("depth"), F.array("dst", "src").alias("trail"), F.array("type").alias("types"))
    levels = []
    for depth in range(1, max_depth + 1):
        now = saved(now, "graph-paths")
        if now.isEmpty():
            break
        levels.append(now)
        e = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("type").alias("_type"))
        step = now.join(e, F.col("node") == F.col("_dst")).where(~F.array_contains("trail", F.col("_src")))
        now = step.select("start", F.col("_src").alias("node"), F.lit(depth + 1).alias("depth"), F.concat("trail", F.array("_src")).alias("trail"), F.concat("types", F.array("_type")).alias("types"))
    return union(levels) if levels else now


def path_risk(types: F.Column, depth: F.Column) -> F.Column:
    has = lambda t: F.array_contains(types, F.lit(t))
    return F.when(has("REFERENCES"), "CRITICAL").when(has("DEPENDS_ON") & (depth <= 2), "HIGH").when(has("DEPENDS_ON") | has("CALLS"), "MEDIUM").otherwise("LOW")


def lineage(flows: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(node, col, origin, origin_col, depth): where each column's values come from, over any number of steps; each origin with its least depth."""
    column = lambda n, c: F.struct(F.col(n).alias("n"), F.col(c).alias("c"))
    back = flows.select(column("a", "ac").alias("dst"), column("b", "bc").alias("src"))
    found = reachable(back, nodes(back), max_depth)
    return found.select(F.col("node.n").alias("node"), F.col("node.c").alias("col"), F.col("start.n").alias("origin"), F.col("start.c").alias("origin_col"), "depth")


#: For the oracle: every simple path that leads to a node's dependents.
_WALK = f"""WITH RECURSIVE {_values('edges', 'src, dst, type', EDGES)}, {_values('flows', 'a, ac, b, bc', FLOWS)}, walk AS (SELECT dst AS start, src AS node, 1 AS depth, concat('/', dst, '/', src, '/') AS trail, type AS types FROM edges
 UNION ALL SELECT w.start, e.src, w.depth + 1, concat(w.trail, e.src, '/'), concat(w.types, ',', e.type) FROM walk w JOIN edges e ON e.dst = w.node WHERE w.trail NOT LIKE concat('%/', e.src, '/%'))"""
_RISK = "CASE WHEN types LIKE '%REFERENCES%' THEN 'CRITICAL' WHEN types LIKE '%DEPENDS_ON%' AND depth <= 2 THEN 'HIGH' WHEN types LIKE '%DEPENDS_ON%' OR types LIKE '%CALLS%' THEN 'MEDIUM' ELSE 'LOW' END"
_WAVES = "waves AS (SELECT n.node, CAST(coalesce(max(w.depth), 0) AS INT) AS wave FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) n LEFT JOIN walk w ON w.node = n.node GROUP BY n.node)"


@query("graph_neighbors", _WALK + " SELECT n.node, CAST((SELECT count(*) FROM edges e WHERE e.src = n.node) AS BIGINT) AS needs, CAST((SELECT count(*) FROM edges e WHERE e.dst = n.node) AS BIGINT) AS needed_by FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) n")
def graph_neighbors(spark, sf):
    e = edges(spark)
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return ends.groupBy("node").agg(F.sum("a").alias("needs"), F.sum("b").alias("needed_by"))


@query("graph_impact", _WALK + " SELECT start, node, min(depth) AS depth FROM walk GROUP BY start, node")
def graph_impact(spark, sf):
    e = edges(spark)
    return reachable(e, nodes(e))


@query("graph_paths_risk", f"{_WALK} SELECT start, node, depth, trail, {_RISK} AS risk FROM walk")
def graph_paths_risk(spark, sf):
    e = edges(spark)
    return paths(e, nodes(e)).select("start", "node", "depth", F.concat(F.lit("/"), F.array_join("trail", "/"), F.lit("/")).alias("trail"), path_risk(F.col("types"), F.col("depth")).alias("risk"))


@query("graph_impact_report", f"{_WALK} SELECT start, {_RISK} AS risk, CAST(count(*) AS BIGINT) AS paths, CAST(count(DISTINCT node) AS BIGINT) AS nodes, max(depth) AS deepest FROM walk GROUP BY start, {_RISK}")
def graph_impact_report(spark, sf):
    e = edges(spark)
    return paths(e, nodes(e)).groupBy("start", path_risk(F.col("types"), F.col("depth")).alias("risk")).agg(F.count(F.lit(1)).alias("paths"), F.count_distinct("node").alias("nodes"), F.max("depth").alias("deepest"))


@query("graph_transitive", _WALK + " SELECT node AS start, start AS needs, min(depth) AS depth FROM walk GROUP BY node, start")
def graph_transitive(spark, sf):
    e = edges(spark)
    return reachable(e, nodes(e)).select(F.col("node").alias("start"), F.col("start").alias("needs"), "depth")


@query("graph_waves", f"{_WALK}, {_WAVES} SELECT wave, CAST(count(*) AS BIGINT) AS nodes, min(node) AS first_node FROM waves GROUP BY wave")
def graph_waves(spark, sf):
    return waves(edges(spark)).groupBy("wave").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("first_node"))


@query("graph_topo", f"{_WALK}, {_WAVES} SELECT node, wave, CAST(row_number() OVER (ORDER BY wave, node) AS BIGINT) AS place FROM waves")
def graph_topo(spark, sf):
    """A place within the wave, after the counts of the waves before: no window holds more than a wave."""
    from pyspark.sql.window import Window

    w = waves(edges(spark))
    before = w.groupBy("wave").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("wave").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a wave
    nth = F.row_number().over(Window.partitionBy("wave").orderBy("node"))
    return w.withColumn("nth", nth).join(before, "wave").select("node", "wave", (F.col("before") + F.col("nth")).alias("place"))


#: Two cycles that share a node, with a tail on either side.
LOOPS = [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("c", "d", "CALLS"), ("d", "c", "CALLS"), ("x", "a", "CALLS"), ("d", "y", "CALLS"), ("y", "z", "CALLS")]


@query("graph_cycles", f"WITH RECURSIVE {_values('edges', 'src, dst, type', LOOPS)}, r AS (SELECT dst AS start, src AS node FROM edges UNION SELECT r.start, e.src FROM r JOIN edges e ON e.dst = r.node) SELECT r.start, r.node FROM r JOIN edges e ON e.src = r.start AND e.dst = r.node")
def graph_cycles(spark, sf):
    return cycles(spark.createDataFrame(LOOPS, "src string, dst string, type string"))


@query("graph_subgraph", _WALK + " SELECT type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT src) AS BIGINT) AS sources, CAST(count(DISTINCT dst) AS BIGINT) AS targets FROM edges WHERE type IN ('REFERENCES', 'CALLS') GROUP BY type")
def graph_subgraph(spark, sf):
    return edges(spark).where(F.col("type").isin("REFERENCES", "CALLS")).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query("column_lineage", f"WITH RECURSIVE {_values('flows', 'a, ac, b, bc', FLOWS)}, up AS (SELECT b AS node, bc AS col, a AS origin, ac AS origin_col, 1 AS depth FROM flows UNION ALL SELECT u.node, u.col, f.a, f.ac, u.depth + 1 FROM up u JOIN flows f ON f.b = u.origin AND f.bc = u.origin_col) SELECT node, col, origin, origin_col, depth FROM up")
def column_lineage(spark, sf):
    return lineage(spark.createDataFrame(FLOWS, "a string, ac string, b string, bc string"))


@query("graph_reachable", f"WITH RECURSIVE {_values('edges', 'src, dst, type', EDGES)}, walk AS (SELECT dst AS start, src AS node, 1 AS depth FROM edges UNION ALL SELECT w.start, e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.node) SELECT start, node, min(depth) AS depth FROM walk WHERE start IN ('region', 'part') GROUP BY start, node")
def graph_reachable(spark, sf):
    return reachable(edges(spark), spark.createDataFrame([("region",), ("part",)], "node string"))


def row_edges(spark, sf: str) -> DataFrame:
    """The rows of the tables as a graph: an order needs its customer, a customer its nation, a nation its region; a line's order its part and supplier."""
    node = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))

    def of(name: str, a: str, ac: str, b: str, bc: str) -> DataFrame:
        return table(spark, sf, name).select(node(a, ac).alias("src"), node(b, bc).alias("dst"), F.lit("REFERENCES").alias("type"))

    return union([of("orders", "o", "o_orderkey", "c", "o_custkey"), of("customer", "c", "c_custkey", "n", "c_nationkey"), of("supplier", "s", "s_suppkey", "n", "s_nationkey"), of("nation", "n", "n_nationkey", "r", "n_regionkey"), of("lineitem", "o", "l_orderkey", "s", "l_suppkey").distinct()])


@query("graph_impact_rows", """WITH n AS (SELECT 'r' || n_regionkey AS start, n_nationkey FROM nation), c AS (SELECT start, c_custkey AS k FROM customer JOIN n ON c_nationkey = n_nationkey), s AS (SELECT start, s_suppkey AS k FROM supplier JOIN n ON s_nationkey = n_nationkey),
 o AS (SELECT DISTINCT start, 'o' || o_orderkey AS node FROM orders JOIN c ON o_custkey = k UNION SELECT DISTINCT start, 'o' || l_orderkey FROM lineitem JOIN s ON l_suppkey = k)
 SELECT start, 1 AS depth, CAST(count(*) AS BIGINT) AS nodes FROM n GROUP BY start UNION ALL SELECT start, 2, CAST(count(*) AS BIGINT) FROM (SELECT start, 'c' || k AS x FROM c UNION ALL SELECT start, 's' || k FROM s) y GROUP BY start UNION ALL SELECT start, 3, CAST(count(*) AS BIGINT) FROM o GROUP BY start""")
def graph_impact_rows(spark, sf):
    """How many rows depend on each region, by distance."""
    e = saved(row_edges(spark, sf), "graph-rows")
    start = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return reachable(e, start).groupBy("start", "depth").agg(F.count(F.lit(1)).alias("nodes"))


@query("graph_waves_rows", "SELECT 0 AS wave, CAST((SELECT count(DISTINCT n_regionkey) FROM nation) AS BIGINT) AS nodes UNION ALL SELECT 1, CAST(count(*) AS BIGINT) FROM nation UNION ALL SELECT 2, CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS BIGINT) UNION ALL SELECT 3, CAST(count(*) AS BIGINT) FROM orders")
def graph_waves_rows(spark, sf):
    return waves(saved(row_edges(spark, sf), "graph-rows")).groupBy("wave").agg(F.count(F.lit(1)).alias("nodes"))


# --- building a graph from texts and keys ---
def references(text: str) -> set[tuple[str, str]]:
    """What a view's or procedure's text needs: (name, DEPENDS_ON or CALLS). Common table expressions and temporary tables are its own."""
    own: set[str] = set()
    found: set[tuple[str, str]] = set()

    def name_at(items: list, k: int) -> str:
        parts = []
        while k < len(items) and isinstance(items[k], Token) and items[k].kind in ("word", "bracket", "quoted"):
            parts.append(items[k].text.strip('[]"').lower())
            if not (k + 1 < len(items) and isinstance(items[k + 1], Token) and items[k + 1].text == "."):
                break
            k += 2
        return parts[-1] if parts else ""

    def walk(items: list) -> None:
        for k, x in enumerate(items):
            if isinstance(x, Group):
                walk(x.items)
                continue
            after = items[k + 1] if k + 1 < len(items) else None
            if x.kind == "word" and isinstance(after, Token) and after.upper == "AS" and k + 2 < len(items) and isinstance(items[k + 2], Group):
                own.add(x.text.lower())
            if x.upper in ("FROM", "JOIN", "INTO", "UPDATE", "EXEC", "EXECUTE", "USING", "TABLE"):
                name = name_at(items, k + 1)
                if name and name not in ("select", "set", "top", "sp_executesql") and not name.startswith(("#", "@")):
                    found.add((name, "CALLS" if x.upper in ("EXEC", "EXECUTE") else "DEPENDS_ON"))

    walk(tree(tokenize(text)))
    aliases = set()
    words = [t.text.lower() for t in tokenize(text)]
    for k, w in enumerate(words[:-2]):  # UPDATE l ... FROM lines l: l is a table's other name
        if w == "update" and any(words[i] == words[k + 1] and words[i - 1] not in ("update", ".", "from", "join") for i in range(k + 2, len(words))):
            aliases.add(words[k + 1])
    return {(n, kind) for n, kind in found if n not in own and n not in aliases}


def graph_edges(spark: SparkSession, texts: dict[str, str], foreign_keys: list[tuple[str, str]]) -> DataFrame:
    """Edges of views and procedures by what their texts name, and of tables by their foreign keys."""
    rows = [(name, needs, kind) for name, text in texts.items() for needs, kind in sorted(references(text)) if needs != name.lower()]
    return spark.createDataFrame([*rows, *((a, b, "REFERENCES") for a, b in foreign_keys)], "src string, dst string, type string")


FOREIGN_KEYS = [("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders")]
TEXTS = {
    **MODEL,
    "p_cancel": "CREATE PROCEDURE p_cancel @id BIGINT AS BEGIN UPDATE l SET l.x = 0 FROM dbo.lineitem l JOIN [orders] o ON o.k = l.k WHERE o.k = @id; INSERT INTO #gone SELECT * FROM orders; END",
    "p_nightly": "CREATE PROCEDURE p_nightly AS BEGIN EXEC dbo.p_cancel @id = 1; WITH big AS (SELECT * FROM cust) SELECT * FROM big JOIN ord ON 1 = 1; END",
}


@query("graph_build_edges", "SELECT * FROM (VALUES ('cust', 'customer', 'DEPENDS_ON'), ('cust', 'nation', 'DEPENDS_ON'), ('cust', 'region', 'DEPENDS_ON'), ('ord', 'orders', 'DEPENDS_ON'), ('item', 'lineitem', 'DEPENDS_ON'), ('prod', 'part', 'DEPENDS_ON'), ('p_cancel', 'lineitem', 'DEPENDS_ON'), ('p_cancel', 'orders', 'DEPENDS_ON'), ('p_nightly', 'cust', 'DEPENDS_ON'), ('p_nightly', 'ord', 'DEPENDS_ON'), ('p_nightly', 'p_cancel', 'CALLS'), "
       + ", ".join(f"('{a}', '{b}', 'REFERENCES')" for a, b in FOREIGN_KEYS) + ") v(src, dst, type)")
def graph_build_edges(spark, sf):
    return graph_edges(spark, TEXTS, FOREIGN_KEYS)


def to_json(edges: DataFrame) -> DataFrame:
    """A row of JSON an edge, for storage or a page."""
    return edges.select(F.to_json(F.struct("src", "dst", "type")).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("json", "src string, dst string, type string").alias("e")).select("e.*")


@query("graph_json_round_trip", f"WITH {_values('e', 'src, dst, type', EDGES)} SELECT * FROM e")
def graph_json_round_trip(spark, sf):
    return from_json(saved(to_json(edges(spark)), "graph-json"))


KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey"}


@query("graph_build", " UNION ALL ".join(f"SELECT 'table' AS type, '{t}' AS name, CAST(NULL AS VARCHAR) AS parent UNION ALL SELECT 'constraint', 'pk_{t}', '{t}' UNION ALL SELECT 'column', column_name, '{t}' FROM (DESCRIBE {t})" for t in KEYS))
def graph_build(spark, sf):
    """Nodes of a schema: tables, columns and key constraints."""
    columns = describe(spark, sf, KEYS)
    tables = columns.select("table_name").distinct().select(F.lit("table").alias("type"), F.col("table_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    keys = spark.createDataFrame([("constraint", f"pk_{t}", t) for t in KEYS], "type string, name string, parent string")
    return tables.unionByName(columns.select(F.lit("column").alias("type"), F.col("column_name").alias("name"), F.col("table_name").alias("parent"))).unionByName(keys)


# --- schema differences ---
OBJECTS = "kind string, parent string, name string, type string"
SOURCE = [("table", "", "customers", ""), ("table", "", "orders", ""), ("column", "customers", "id", "INT"), ("column", "customers", "name", "NVARCHAR (100)"), ("column", "customers", "email", "VARCHAR(100)"), ("column", "orders", "id", "INT"), ("column", "orders", "customer_id", "INT"), ("constraint", "customers", "pk_customers", "PK"), ("constraint", "orders", "fk_orders", "FK"), ("constraint", "orders", "ck_orders", "CHECK"), ("index", "customers", "ix_name", ""), ("edge", "orders", "customers", "REFERENCES")]
TARGET = [("table", "", "customers", ""), ("table", "", "archive", ""), ("column", "customers", "id", "int"), ("column", "customers", "name", "VARCHAR(100)"), ("constraint", "customers", "pk_customers", "PK")]


def schema_differences(source: DataFrame, target: DataFrame) -> DataFrame:
    """What the target lacks, has besides or types differently, with a severity. Types are compared without case and blanks.

    Columns, keys and indexes of a missing table are reported with it; additional columns are not reported.
    """
    key = ["kind", "parent", "name"]
    gone = source.join(target, key, "left_anti")
    no_table = source.where("kind = 'table'").join(target.where("kind = 'table'"), "name", "left_anti").select(F.col("name").alias("parent"))
    lost = F.when(F.col("kind") == "table", "TABLE_MISSING").when(F.col("kind") == "column", "COLUMN_MISSING").when(F.col("kind") == "constraint", "CONSTRAINT_LOSS").when(F.col("kind") == "index", "INDEX_MISSING").otherwise("DEPENDENCY_BROKEN")
    weight = F.when(F.col("kind") == "table", "CRITICAL").when(F.col("kind") == "index", "MEDIUM").when((F.col("kind") == "constraint") & ~F.col("type").isin("PK", "FK"), "MEDIUM").otherwise("HIGH")
    missing = gone.where("kind in ('table', 'edge')").unionByName(gone.where("kind not in ('table', 'edge')").join(no_table, "parent", "left_anti").select(*source.columns))
    plain = lambda c: F.upper(F.replace(c, F.lit(" "), F.lit("")))
    typed = source.alias("a").join(target.alias("b"), key).where((F.col("kind") == "column") & (plain(F.col("a.type")) != plain(F.col("b.type"))))
    extra = target.where("kind = 'table'").join(source, key, "left_anti")
    out = missing.select(lost.alias("difference"), "parent", "name", weight.alias("severity"))
    out = out.unionByName(typed.select(F.lit("TYPE_MISMATCH").alias("difference"), "parent", "name", F.lit("HIGH").alias("severity")))
    return out.unionByName(extra.select(F.lit("TABLE_EXTRA").alias("difference"), "parent", "name", F.lit("LOW").alias("severity")))


@query("schema_diff", f"""WITH {_values('s', 'kind, parent, name, type', SOURCE)}, {_values('t', 'kind, parent, name, type', TARGET)}, gone AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.kind = s.kind AND t.parent = s.parent AND t.name = s.name)), nt AS (SELECT name FROM gone WHERE kind = 'table')
 SELECT CASE kind WHEN 'table' THEN 'TABLE_MISSING' WHEN 'column' THEN 'COLUMN_MISSING' WHEN 'constraint' THEN 'CONSTRAINT_LOSS' WHEN 'index' THEN 'INDEX_MISSING' ELSE 'DEPENDENCY_BROKEN' END AS difference, parent, name, CASE WHEN kind = 'table' THEN 'CRITICAL' WHEN kind = 'index' OR (kind = 'constraint' AND type NOT IN ('PK', 'FK')) THEN 'MEDIUM' ELSE 'HIGH' END AS severity FROM gone WHERE kind IN ('table', 'edge') OR parent NOT IN (SELECT name FROM nt)
 UNION ALL SELECT 'TYPE_MISMATCH', s.parent, s.name, 'HIGH' FROM s JOIN t ON s.kind = t.kind AND s.parent = t.parent AND s.name = t.name WHERE s.kind = 'column' AND upper(replace(s.type, ' ', '')) <> upper(replace(t.type, ' ', ''))
 UNION ALL SELECT 'TABLE_EXTRA', parent, name, 'LOW' FROM t WHERE kind = 'table' AND name NOT IN (SELECT name FROM s WHERE kind = 'table')""")
def schema_diff(spark, sf):
    return schema_differences(spark.createDataFrame(SOURCE, OBJECTS), spark.createDataFrame(TARGET, OBJECTS))


@query("schema_diff_impact", f"""WITH RECURSIVE {_values('edges', 'src, dst, type', EDGES)}, lost(difference, name) AS (VALUES ('TABLE_MISSING', 'nation'), ('COLUMN_MISSING', 'orders')),
 r AS (SELECT l.difference, l.name, e.src AS node, 1 AS depth FROM lost l JOIN edges e ON e.dst = l.name UNION ALL SELECT r.difference, r.name, e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.node)
 SELECT difference, name, node, min(depth) AS depth FROM r GROUP BY difference, name, node""")
def schema_diff_impact(spark, sf):
    """The chain of what each difference between two schemas reaches."""
    objects = [("table", "", "nation", ""), ("table", "", "orders", ""), ("column", "nation", "n_name", "STRING"), ("column", "orders", "o_totalprice", "DOUBLE")]
    differences = schema_differences(spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(objects[1:2], OBJECTS))
    return difference_impact(differences, edges(spark))


def difference_impact(differences: DataFrame, edges: DataFrame) -> DataFrame:
    """(difference, name, node, depth): what depends on each table that differs, or one of whose parts does."""
    on = differences.select("difference", F.when(F.col("parent") == "", F.col("name")).otherwise(F.col("parent")).alias("name")).distinct()
    reach = reachable(edges, on.select(F.col("name").alias("node")).distinct())
    return on.join(reach, F.col("name") == F.col("start")).select("difference", "name", "node", "depth")
