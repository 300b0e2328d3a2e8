"""Registered queries of the rules over bound facts, which the driver's tables stand in for, and of claims' writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import rules
from cairn.operators import bound_facts, changes, decorate, extract, ledger, orientation, reads
from cairn.plans.catalog import _OWNERS, ORDER, PART, PRELUDE, query
from cairn.plans.oracles import surface_levels
from cairn.session import read
from cairn.sources.projection import Graph



@query("""WITH t AS (SELECT p_partkey AS id, p_partkey // 3 AS base_id, p_size % 5 = 0 AS obj, p_size, p_brand FROM part)
SELECT id AS source_id, base_id AS target_id, 'code' AS domain, 'inherits' AS kind, NULL::VARCHAR AS dispatch_kind, NULL::VARCHAR AS logical_scope FROM t WHERE NOT obj
UNION SELECT id, unnest([p_size % 7, p_size % 11]), 'code', 'implements', NULL, NULL FROM t
UNION SELECT l_orderkey, l_suppkey, 'code', 'implements_member', NULL, NULL FROM lineitem UNION SELECT l_orderkey, l_partkey, 'code', 'overrides', NULL, NULL FROM lineitem WHERE l_linenumber > 2""")
def type_relations(spark, sf_dir):
    g = Graph(spark, sf_dir)
    t = g.sql("SELECT p_partkey AS id, p_partkey div 3 AS base_id, p_size % 5 = 0 AS base_is_object, array(CAST(p_size % 7 AS BIGINT), CAST(p_size % 11 AS BIGINT)) AS interface_ids FROM part")
    m = g.sql("SELECT l_orderkey AS id, array(l_suppkey) AS implements_ids, CASE WHEN l_linenumber > 2 THEN l_partkey END AS overridden_id FROM lineitem")
    return bound_facts.type_relations(t, m)


_OPS = "CASE l_linenumber % 4 WHEN 0 THEN 'call' WHEN 1 THEN 'construct' WHEN 2 THEN 'access' ELSE 'type' END"
_SYNTAX = "CASE CAST(l_quantity AS INT) % 7 WHEN 0 THEN 'compound' WHEN 1 THEN 'increment' WHEN 2 THEN 'ref' WHEN 3 THEN 'assignment' WHEN 4 THEN 'out' ELSE 'value' END"
_USES = f"SELECT l_orderkey % 97 AS source_id, l_partkey % 97 AS target_id, {_OPS} AS operation, {_SYNTAX} AS syntax, l_suppkey % 5 = 0 AS is_extension, l_suppkey % 3 = 0 AS is_static, CASE WHEN l_suppkey % 2 = 0 THEN 'interface' ELSE 'class' END AS container, l_returnflag = 'A' AS is_virtual FROM lineitem"


@query(f"""SELECT DISTINCT source_id, target_id, 'code' AS domain, CASE operation WHEN 'call' THEN 'calls' WHEN 'construct' THEN 'constructs' WHEN 'type' THEN 'uses_type' ELSE CASE WHEN syntax IN ('compound', 'increment', 'ref') THEN 'reads_writes' WHEN syntax IN ('assignment', 'out') THEN 'writes' ELSE 'reads' END END AS kind,
CASE WHEN operation = 'call' THEN CASE WHEN is_extension THEN 'extension' WHEN is_static THEN 'static' WHEN container = 'interface' THEN 'interface' WHEN is_virtual THEN 'virtual' ELSE 'direct' END END AS dispatch_kind, NULL::VARCHAR AS logical_scope FROM ({_USES}) WHERE source_id <> target_id OR operation = 'call'""")
def usage_relations(spark, sf_dir):
    return bound_facts.usage_relations(Graph(spark, sf_dir).sql(_USES))


_TYPES = "SELECT CAST(n_nationkey AS BIGINT) AS id, concat('T', n_nationkey) AS name FROM nation"
_ATTRIBUTE = "CASE c_custkey % 6 WHEN 0 THEN 'FromBodyAttribute' WHEN 1 THEN 'FromQueryAttribute' WHEN 2 THEN 'FromServicesAttribute' ELSE 'ObsoleteAttribute' END"


@query(f"""WITH p AS (SELECT c_custkey AS e, concat('T', c_nationkey) AS t, CASE c_custkey % 6 WHEN 0 THEN 'body' WHEN 1 THEN 'query' WHEN 2 THEN 'services' ELSE CASE WHEN c_custkey % 4 = 0 THEN 'services' ELSE 'inferred' END END AS s FROM customer)
SELECT DISTINCT e AS source_id, n.id AS target_id, 'framework' AS domain, CASE WHEN s = 'services' THEN 'resolves_parameter' ELSE 'binds_request' END AS kind, NULL::VARCHAR AS dispatch_kind, s AS logical_scope FROM p JOIN ({_TYPES}) n ON n.name = p.t
UNION SELECT c_custkey, n.id, 'framework', 'returns_response', NULL, NULL FROM customer JOIN ({_TYPES}) n ON n.name IN (concat('T', c_nationkey % 5), concat('T', c_nationkey % 7))""")
def contract_relations(spark, sf_dir):
    g = Graph(spark, sf_dir)
    p = g.sql(f"SELECT c_custkey AS endpoint_id, concat('List<Shop.T', c_nationkey, '[]>') AS type_name, array({_ATTRIBUTE}) AS attributes, c_custkey % 4 = 0 AS is_interface FROM customer")
    r = g.sql("SELECT c_custkey AS endpoint_id, concat('Task<ActionResult<Page.T', c_nationkey % 5, '>, T', c_nationkey % 7, '>') AS type_name FROM customer")
    return bound_facts.contract_relations(p, r, g.sql(_TYPES))


_POLICED = "SELECT o_orderkey AS id, o_orderstatus = 'P' AS allow_anonymous, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority END AS policy FROM orders"


@query(f"SELECT id AS source_id, concat('authorization_policy:', sha256(policy)) AS policy_key, 'requires_policy' AS kind FROM ({_POLICED}) WHERE policy IS NOT NULL AND NOT allow_anonymous GROUP BY ALL")
def policy_relations(spark, sf_dir):
    return bound_facts.policy_relations(Graph(spark, sf_dir).sql(_POLICED))[1]


_FACTS = "SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_nationkey AS BIGINT) AS project_id, CASE WHEN s_suppkey % 2 = 0 THEN 'endpoint_mapping' ELSE 'service_configuration' END AS category, CASE WHEN s_suppkey % 3 = 0 THEN 'AddHub' ELSE 'UseControllers' END AS method FROM supplier"
_ENDS = "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS project_id, c_custkey % 5 = 0 AS is_minimal FROM customer"
_SPACES = "SELECT p_partkey AS id, p_partkey % 25 AS project_id, CASE WHEN p_size % 2 = 0 THEN 'App.Controllers' ELSE 'App.Models' END AS name FROM part"


@query(f"""WITH f AS (SELECT * FROM ({_FACTS}) WHERE method LIKE '%Controller%'), m AS (SELECT * FROM f WHERE category = 'endpoint_mapping'), c AS (SELECT * FROM f WHERE category = 'service_configuration')
SELECT m.id AS source_id, n.id AS target_id, 'framework' AS domain, 'activates_controller_namespace' AS kind, NULL::VARCHAR AS dispatch_kind, m.method AS logical_scope FROM m JOIN ({_SPACES}) n USING (project_id) WHERE n.name = 'App.Controllers'
UNION ALL SELECT m.id, e.id, 'framework', 'activates_endpoint', NULL, m.method FROM m JOIN ({_ENDS}) e USING (project_id) WHERE NOT e.is_minimal
UNION ALL SELECT c.id, m.id, 'framework', 'enables_endpoint_mapping', NULL, c.method FROM c JOIN m USING (project_id)""")
def host_relations(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return bound_facts.host_relations(g.sql(_FACTS), g.sql(_ENDS), g.sql(_SPACES))


@query("""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ['get', 'head'] WHEN c_custkey % 3 = 1 THEN ['post'] ELSE ['ANY'] END AS v FROM customer)
SELECT c_custkey AS action_id, upper(unnest(v)) AS verb, CASE WHEN c_custkey % 4 = 0 THEN concat('/x/', c_custkey) ELSE concat('/api/C', c_custkey, '/Go/{id}') END AS route, CASE WHEN c_custkey % 5 = 0 THEN 'anonymous' WHEN c_custkey % 5 = 1 THEN 'policy:p' WHEN c_custkey % 5 = 2 THEN 'roles:r' WHEN c_custkey % 5 = 3 THEN 'authenticated' ELSE 'unspecified' END AS "authorization" FROM a""")
def controller_endpoints(spark, sf_dir):
    text = "SELECT c_custkey AS action_id, concat('C', c_custkey, 'Controller') AS controller, 'Go' AS method, 'api/[controller]' AS prefix, CASE WHEN c_custkey % 4 = 0 THEN concat('/x/', c_custkey) ELSE '[action]/~id~' END AS template, CASE c_custkey % 3 WHEN 0 THEN array('get', 'head') WHEN 1 THEN array('post') ELSE CAST(array() AS ARRAY<STRING>) END AS verbs, c_custkey % 5 = 0 AS allow_anonymous, CASE WHEN c_custkey % 5 = 1 THEN 'p' END AS policy, CASE WHEN c_custkey % 5 = 2 THEN 'r' END AS roles, c_custkey % 5 = 3 AS authorize FROM customer"
    a = Graph(spark, sf_dir).sql(text).withColumn("template", F.replace("template", F.lit("~id~"), F.lit("{id}")))
    return bound_facts.endpoint_rows(a).select("action_id", "verb", "route", "authorization")


@query("SELECT o_orderkey AS method_id, CASE WHEN o_orderkey % 4 = 0 THEN 'nunit' ELSE 'xunit' END AS framework FROM orders WHERE o_orderkey % 4 < 2")
def test_cases(spark, sf_dir):
    text = "SELECT o_orderkey AS method_id, CASE o_orderkey % 4 WHEN 0 THEN array('TestAttribute', 'Theory') WHEN 1 THEN array('FactAttribute') ELSE array('Obsolete') END AS attributes FROM orders"
    return bound_facts.test_cases(Graph(spark, sf_dir).sql(text))


_CALLS = "SELECT l_orderkey AS method_id, CASE WHEN l_linenumber % 2 = 0 THEN concat('select * from T', l_partkey % 50, ' join u', l_suppkey % 9, ' on 1=1') END AS sql, CASE WHEN l_linenumber % 2 = 1 THEN CASE l_returnflag WHEN 'A' THEN 'AddAsync' WHEN 'N' THEN 'ToList' ELSE 'Include' END END AS ef_method, concat('T', l_partkey % 50) AS table_name, l_partkey AS entity_id FROM lineitem"


@query(f"""SELECT DISTINCT method_id, unnest([concat('t', regexp_extract(sql, 'from T(\\d+)', 1)), concat('u', regexp_extract(sql, 'join u(\\d+)', 1))]) AS object, 'reads' AS effect, 'executes_sql' AS via FROM ({_CALLS}) WHERE sql IS NOT NULL
UNION SELECT method_id, lower(table_name), CASE ef_method WHEN 'AddAsync' THEN 'inserts' ELSE 'reads' END, 'executes_ef' FROM ({_CALLS}) WHERE ef_method IN ('AddAsync', 'ToList')""")
def data_operations(spark, sf_dir):
    return bound_facts.data_operations(Graph(spark, sf_dir).sql(_CALLS))


@query(f"SELECT DISTINCT method_id, entity_id, CASE WHEN ef_method = 'ToList' THEN 'materializes' ELSE 'persists' END AS kind FROM ({_CALLS}) WHERE ef_method IS NOT NULL")
def entity_flow(spark, sf_dir):
    return bound_facts.entity_flow(Graph(spark, sf_dir).sql(_CALLS))


_STEPS = "SELECT l_orderkey AS migration_id, l_linenumber AS ordinal, CASE l_linenumber % 4 WHEN 0 THEN 'CreateTable' WHEN 1 THEN 'AddColumn' WHEN 2 THEN 'Sql' ELSE 'Unheard' END AS operation, concat('T', l_partkey) AS object, CASE WHEN l_linenumber % 4 = 2 THEN concat('delete from X', l_suppkey) END AS sql FROM lineitem"


@query(f"SELECT migration_id, ordinal, CASE WHEN sql IS NULL THEN lower(object) ELSE lower(replace(sql, 'delete from ', '')) END AS object, CASE operation WHEN 'CreateTable' THEN 'creates' WHEN 'AddColumn' THEN 'adds_column' ELSE 'deletes' END AS kind FROM ({_STEPS}) WHERE operation <> 'Unheard'")
def migration_operations(spark, sf_dir):
    return bound_facts.migration_operations(Graph(spark, sf_dir).sql(_STEPS))


@query("""WITH c AS (SELECT concat('t', n_regionkey) AS t, n_name AS o, n_nationkey % 2 = 0 AS k, ['a', concat('c', n_nationkey)] AS cols FROM nation)
SELECT o AS source, concat(t, '.', unnest(cols)) AS target, 'includes_column' AS kind FROM c UNION ALL SELECT t, o, CASE WHEN k THEN 'has_primary_key' ELSE 'has_index' END FROM c UNION ALL SELECT o, t, CASE WHEN k THEN 'primary_key_of' ELSE 'indexes' END FROM c""")
def keys_and_indexes(spark, sf_dir):
    return extract.keys_and_indexes(Graph(spark, sf_dir).sql("SELECT concat('t', n_regionkey) AS table_name, n_name AS object_name, n_nationkey % 2 = 0 AS is_key, array('a', concat('c', n_nationkey)) AS column_names FROM nation"))


_DECLARED = "SELECT concat('m:', o_orderkey) AS stable_key, concat('p:', o_custkey % 25) AS project_key, CASE o_orderstatus WHEN 'F' THEN 'method' WHEN 'O' THEN 'property' ELSE 'unheard' END AS kind, concat('M', o_orderkey) AS name, concat('N.M', o_orderkey) AS qualified_name, o_orderpriority AS signature, 'public' AS visibility, CASE WHEN o_orderkey % 3 = 0 THEN concat('p:', o_custkey % 25, ':c') END AS container_key FROM orders"


@query(f"""SELECT stable_key, kind, name, qualified_name, signature, visibility, coalesce(container_key, project_key) AS container_key, n.path, n.line AS start_line, CASE WHEN n.k = 1 THEN 'definition' ELSE 'partial_definition' END AS location_kind FROM ({_DECLARED}) d
JOIN (SELECT concat('m:', l_orderkey) AS stable_key, concat('f', l_suppkey) AS path, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY concat('f', l_suppkey), l_linenumber) AS k FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber FROM lineitem)) n USING (stable_key) WHERE kind <> 'unheard'""")
def declarations(spark, sf_dir):
    g = Graph(spark, sf_dir)
    spans = g.sql("SELECT DISTINCT concat('m:', l_orderkey) AS stable_key, concat('f', l_suppkey) AS path, l_linenumber AS start_line FROM lineitem")
    return extract.declarations(g.sql(_DECLARED), spans)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('api/', '{', CASE WHEN o_orderkey % 2 = 0 THEN 'id' ELSE 'value' END, '}', '/', o_orderpriority) END AS template FROM orders""")
def request_templates(spark, sf_dir):
    text = "SELECT o_orderkey AS id, array(named_struct('kind', 'text', 'value', 'api/'), named_struct('kind', 'hole', 'value', CASE WHEN o_orderkey % 2 = 0 THEN 'id' END), named_struct('kind', 'text', 'value', '/'), named_struct('kind', CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE 'text' END, 'value', o_orderpriority)) AS parts FROM orders"
    return Graph(spark, sf_dir).sql(text).select("id", rules.folded_template(F.col("parts")).alias("template"))


_PROPERTIES = "SELECT l_orderkey AS entity_id, concat('E', l_orderkey) AS entity_name, CASE l_linenumber WHEN 1 THEN 'ID' WHEN 2 THEN concat('e', l_orderkey, 'Id') ELSE concat('P', l_linenumber) END AS property, CASE WHEN l_suppkey % 4 = 0 THEN concat('f', l_suppkey) END AS fluent_column, CASE WHEN l_suppkey % 3 = 0 THEN concat('a', l_suppkey) END AS attribute_column, CASE WHEN l_partkey % 5 = 0 THEN true WHEN l_partkey % 5 = 1 THEN false END AS fluent_required, l_partkey % 2 = 0 AS annotated_nullable, l_returnflag = 'A' AS has_key_attribute, CASE WHEN l_partkey % 7 = 0 THEN l_partkey % 2 = 0 END AS fluent_key FROM lineitem"


@query(f"""WITH p AS (SELECT *, coalesce(fluent_key, has_key_attribute OR lower(property) = 'id' OR lower(property) = lower(entity_name) || 'id') AS k FROM ({_PROPERTIES}))
SELECT entity_id, property, coalesce(fluent_column, attribute_column, property) AS "column", CASE WHEN k THEN false WHEN fluent_required IS NOT NULL THEN NOT fluent_required ELSE annotated_nullable END AS nullable, k AS is_key FROM p""")
def ef_columns(spark, sf_dir):
    return extract.ef_columns(Graph(spark, sf_dir).sql(_PROPERTIES))


# Orientation, states


_FACETS = "SELECT CAST(1000 + n_nationkey AS BIGINT) AS project_id, unnest_facet AS facet FROM (SELECT n_nationkey, explode(CASE n_nationkey % 4 WHEN 0 THEN array('test') WHEN 1 THEN array('application', 'worker') WHEN 2 THEN array('library') ELSE array('migration', 'tool') END) AS unnest_facet FROM nation)"


@query("""WITH p AS (SELECT CAST(1000 + n_nationkey AS BIGINT) AS owner_id, n_nationkey % 4 AS k, n_name, concat('"', n_name, '/', n_name, '.csproj"') AS q FROM nation), s AS (SELECT CAST(100 + r_regionkey AS BIGINT) AS owner_id, concat('"', r_name, '.sln"') AS q FROM region)
SELECT owner_id, 'build' AS kind, concat('dotnet build ', q) AS command, 'derived_from_msbuild' AS origin FROM p UNION ALL SELECT owner_id, 'test', concat('dotnet test ', q), 'derived_from_msbuild' FROM p WHERE k = 0
UNION ALL SELECT owner_id, 'run', concat('dotnet run --project ', q), 'derived_from_msbuild' FROM p WHERE k IN (1, 3) UNION ALL SELECT owner_id, 'package', concat('dotnet pack ', q), 'derived_from_msbuild' FROM p WHERE k = 2 AND owner_id % 3 <> 0
UNION ALL SELECT owner_id, 'migrate', concat('dotnet ef database update --project ', q), 'derived_from_ef_package' FROM p WHERE k = 3
UNION ALL SELECT owner_id, v.kind, concat('dotnet ', v.kind, ' ', q), 'derived_from_solution' FROM s CROSS JOIN (VALUES ('build'), ('test'), ('format')) AS v(kind)""")
def derived_commands(spark, sf_dir):
    g = Graph(spark, sf_dir)
    p = g.sql("SELECT CAST(1000 + n_nationkey AS BIGINT) AS owner_id, n_name AS name, concat(n_name, '/', n_name, '.csproj') AS path, (1000 + n_nationkey) % 3 <> 0 AS packable FROM nation")
    s = g.sql("SELECT CAST(100 + r_regionkey AS BIGINT) AS owner_id, r_name AS name, concat(r_name, '.sln') AS path FROM region")
    return orientation.derived_commands(p, s, g.sql(_FACETS).withColumnRenamed("project_id", "owner_id")).select("owner_id", "kind", "command", "origin")


@query(f"""{PRELUDE} SELECT CASE WHEN n = 0 THEN 'not_started' ELSE 'current' END AS indexing_state, concat('generation 1: ', p, ' projects, ', f, ' files, ', n, ' relations') AS message FROM (SELECT (SELECT count(*) FROM relations) AS n, (SELECT count(*) FROM files) AS f, (SELECT count(*) FROM entities WHERE kind = 'project') AS p)""")
def foundation_status(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return reads.foundation_status(1, g.served("entities"), g.served("files"), g.served("relations"))


@query(f"{PRELUDE}, asked AS (SELECT c_custkey + 10000000 - c_custkey % 3 * 5000000 AS id FROM customer) SELECT a.id, CASE WHEN e.id IS NULL THEN 'entity_not_found' ELSE 'current' END AS state FROM asked a LEFT JOIN entities e ON e.id = a.id")
def entity_states(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return reads.entity_states(g.sql("SELECT c_custkey + 10000000 - c_custkey % 3 * 5000000 AS id FROM customer"), g.served("entities"))


_BATCHES = "SELECT event_id AS ord, concat('repo', user_id % 7) AS repository, event_type AS status, concat('f', event_id) AS path FROM events"


@query(f"SELECT repository, count(*) AS n_files, string_agg(path, ',' ORDER BY ord) AS paths FROM ({_BATCHES}) GROUP BY repository")
def repository_projection(spark, sf_dir):
    return changes.repository_projection(Graph(spark, sf_dir).sql(_BATCHES)).select("repository", "n_files", F.array_join("files.path", ",").alias("paths"))


# Impacts of changes


_SEEDS = [PART, PART + 1, ORDER]
_DOMAINS = ["code", "framework", "database"]


def _impacts_sql() -> str:
    ctes = "".join(surface_levels(s, 2, 100, _DOMAINS, PRELUDE if k == 0 else "", f"_{k}") for k, s in enumerate(_SEEDS))
    every = " UNION ALL ".join(f"SELECT {k} AS k, CAST({s} AS BIGINT) AS seed, * FROM items_{k}" for k, s in enumerate(_SEEDS))
    return f"""{ctes}, {_OWNERS}, occ AS (SELECT x.*, row_number() OVER (ORDER BY k, depth, place) AS t FROM ({every}) x LEFT JOIN owners o ON o.id = x.entity_id WHERE x.entity_id NOT IN ({', '.join(map(str, _SEEDS))}) AND coalesce((o.project_id - 1000) % 5 <> 0, true)),
firsts AS (SELECT entity_id, min(t) AS f, row_number() OVER (ORDER BY min(t)) AS r FROM occ GROUP BY entity_id), full_at AS (SELECT coalesce(max(f) FILTER (WHERE r = 100), 1000000) AS t FROM firsts)
SELECT entity_id, seed, depth, direction, kind FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY depth, t) AS n FROM occ WHERE t <= (SELECT t FROM full_at)) WHERE n = 1"""


@query(_impacts_sql())
def change_impacts(spark, sf_dir):
    g = Graph(spark, sf_dir)
    tests = g.served("entities").where("kind = 'project' AND (id - 1000) % 5 = 0").select(F.col("id").alias("project_id"))
    return changes.change_impacts(g.served("relations"), _SEEDS, g.served("entities"), None, tests)


# Writing claims


def _now(g: Graph) -> decorate.Current:
    key = lambda c: F.concat(F.lit("e:"), F.col(c).cast("string"))
    e = g.served("entities").select("id", key("id").alias("stable_key"), "kind", "qualified_name", F.sha2("qualified_name", 256).alias("fingerprint"))
    r = g.served("relations").select("id", key("source_id").alias("source_key"), key("target_id").alias("target_key"), "kind", F.concat_ws("|", "domain", "dispatch_kind").alias("fingerprint"))
    f = g.served("files").select(F.concat(F.lit("f:"), F.col("id").cast("string")).alias("stable_key"), "relative_path", "content_hash")
    c = read(g.spark, g.sf_dir, "labels").select(F.col("doc_id").alias("claim_id"))
    return decorate.Current(1, e, r, f, c, g.spark.createDataFrame([("roslyn", "4"), ("sql", "2")], "name string, version string"))


_PROOF = "SELECT event_id AS claim_id, CAST(event_id % 3 AS INT) AS ordinal, CASE event_id % 7 WHEN 0 THEN 'entity' WHEN 1 THEN 'relation' WHEN 2 THEN 'source_location' WHEN 3 THEN 'claim' WHEN 4 THEN 'manual' WHEN 5 THEN 'route' ELSE 'documentation' END AS kind, CASE WHEN event_id % 7 = 1 THEN concat('e:', 1000 + event_id % 30) ELSE concat('e:', 10000000 + event_id % 2000) END AS source_key, concat('e:', 10000000 + event_id) AS target_key, 'contains' AS relation_kind, concat(n_name, '/', c_name, CASE WHEN event_id % 3 = 0 THEN '.ts' ELSE '.cs' END) AS path, event_id % 500 AS ref_claim, CASE WHEN event_id % 2 = 0 THEN 'seen' END AS reason FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey"


@query(f"""{PRELUDE}, p AS ({_PROOF}), e AS (SELECT concat('e:', id) AS k, sha256(qualified_name) AS fp FROM entities), r AS (SELECT concat('e:', source_id) AS s, concat('e:', target_id) AS t, kind AS rk, min(CAST(id AS VARCHAR)) AS rid, arg_min(concat_ws('|', domain, dispatch_kind), CAST(id AS VARCHAR)) AS fp FROM relations GROUP BY ALL),
f AS (SELECT relative_path, concat('f:', id) AS k, content_hash FROM files)
SELECT claim_id, ordinal, kind, 'entity' AS dependency_kind, source_key AS key, e.fp AS expected, CASE WHEN e.k IS NULL THEN 'not a current entity' END AS error FROM p LEFT JOIN e ON e.k = source_key WHERE kind = 'entity'
UNION ALL SELECT claim_id, ordinal, p.kind, 'relation', r.rid, r.fp, CASE WHEN r.rid IS NULL THEN 'not a current relation' END FROM p LEFT JOIN r ON r.s = source_key AND r.t = target_key AND r.rk = relation_kind WHERE p.kind = 'relation'
UNION ALL SELECT claim_id, ordinal, kind, 'file', f.k, f.content_hash, CASE WHEN f.k IS NULL THEN 'not a current file' END FROM p LEFT JOIN f ON f.relative_path = p.path WHERE kind IN ('source_location', 'documentation')
UNION ALL SELECT claim_id, ordinal, kind, 'claim', CAST(ref_claim AS VARCHAR), 'present', CASE WHEN ref_claim NOT IN (SELECT doc_id FROM labels) THEN 'not a claim of this workspace' END FROM p WHERE kind = 'claim'
UNION ALL SELECT claim_id, ordinal, kind, NULL, NULL, NULL, CASE WHEN reason IS NULL THEN 'manual evidence needs a reason' END FROM p WHERE kind = 'manual'
UNION ALL SELECT claim_id, ordinal, kind, NULL, NULL, NULL, 'routes aren''t stored, so they are no evidence' FROM p WHERE kind = 'route'""")
def evidence_resolution(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return decorate.resolve_evidence(g.sql(_PROOF), _now(g))


_SELECTED = "SELECT event_id AS claim_id, CASE WHEN event_id % 4 <> 0 THEN concat('e:', 10000000 + event_id % 3000) END AS stable_key, CASE WHEN event_id % 4 IN (0, 1) AND event_id % 8 <> 0 THEN 10000000 + event_id % 3000 END AS entity_id, CASE WHEN event_id % 3 = 0 THEN 'class' WHEN event_id % 3 = 1 THEN 'file' END AS expected_kind, CAST(NULL AS VARCHAR(100)) AS expected_name FROM events"


@query(f"""{PRELUDE}, s AS ({_SELECTED}), x AS (SELECT s.claim_id, (s.stable_key IS NULL) = (s.entity_id IS NULL) AS bad, e.id, e.kind, s.expected_kind FROM s LEFT JOIN entities e ON e.id = coalesce(CAST(substr(s.stable_key, 3) AS BIGINT), s.entity_id))
SELECT claim_id, CASE WHEN bad THEN 'give exactly one of stable_key and entity_id' WHEN id IS NULL THEN 'not a current entity' WHEN expected_kind <> kind THEN concat('expectedKind does not match ', kind) END AS selector_error, CASE WHEN NOT bad AND id IS NOT NULL AND (expected_kind IS NULL OR expected_kind = kind) THEN id END AS resolved_id FROM x""")
def selector_resolution(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return decorate.resolve_selectors(g.sql(_SELECTED), _now(g).entities).select("claim_id", "selector_error", "resolved_id")


_NEEDS = "SELECT event_id AS claim_id, CASE event_id % 6 WHEN 0 THEN 'entity' WHEN 1 THEN 'file' WHEN 2 THEN 'relation' WHEN 3 THEN 'relation_id' WHEN 4 THEN 'claim' ELSE 'analyzer' END AS kind, CASE event_id % 6 WHEN 0 THEN concat('e:', 10000000 + event_id % 2000) WHEN 1 THEN concat('f:', 10000000 + event_id % 2000) WHEN 2 THEN CAST(event_id AS STRING) WHEN 3 THEN CAST(event_id * 40 AS STRING) WHEN 4 THEN CAST(event_id % 300 AS STRING) ELSE 'roslyn' END AS key, CASE event_id % 6 WHEN 5 THEN CAST(3 + event_id % 2 AS STRING) WHEN 4 THEN 'present' WHEN 3 THEN 'present' WHEN 2 THEN 'code|A' ELSE sha2(concat('Customer#', event_id), 256) END AS expected FROM events"


@query(f"""{PRELUDE}, d AS ({_NEEDS.replace('sha2(', 'sha256(').replace(', 256)', ')')}), now AS (SELECT 'entity' AS kind, concat('e:', id) AS key, sha256(qualified_name) AS value FROM entities UNION ALL SELECT 'file', concat('f:', id), content_hash FROM files UNION ALL SELECT 'relation', CAST(id AS VARCHAR), concat_ws('|', domain, dispatch_kind) FROM relations UNION ALL SELECT 'relation_id', CAST(id AS VARCHAR), 'present' FROM relations UNION ALL SELECT 'claim', CAST(doc_id AS VARCHAR), 'present' FROM labels UNION ALL SELECT 'analyzer', 'roslyn', '4' UNION ALL SELECT 'analyzer', 'sql', '2')
SELECT claim_id, count(*) FILTER (WHERE expected IS DISTINCT FROM value) AS n_stale, min(CASE WHEN expected IS DISTINCT FROM value THEN concat(d.kind, ' ', d.key, CASE WHEN value IS NULL THEN ' no longer exists' ELSE ' changed' END) END) AS reason FROM d LEFT JOIN now USING (kind, key) GROUP BY claim_id""")
def claim_freshness_six(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return ledger.freshness(g.sql(_NEEDS), _now(g).values())

