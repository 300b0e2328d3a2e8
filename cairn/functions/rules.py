"""Column rules of the fact extractors: languages, routes, SQL, signatures, statuses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {ext: lang for lang, exts in {"csharp": "cs", "razor": "cshtml razor", "typescript": "ts", "typescriptreact": "tsx", "javascript": "js", "javascriptreact": "jsx", "sql": "sql", "markdown": "md", "xml": "csproj props slnx targets", "yaml": "yaml yml", "json": "json"}.items() for ext in exts.split()}
ADMITTED = sorted(set(LANGUAGES) - {"json"} | {"sln", "editorconfig"})
NAMED_FILES = "^(global\\.json|package(-lock)?\\.json|pnpm-lock\\.yaml|yarn\\.lock|tsconfig.*\\.json)$"
EXCLUDED_DIRS = "(?i)(^|/)(\\.git|\\.vs|\\.idea|node_modules|bin|obj|dist|out|bin_[^/]*|obj_[^/]*)/"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(known, extension(path)), F.lit("text"))


def admitted(path: Column) -> Column:
    """Known extensions and named files outside of excluded folders."""
    return (extension(path).isin(*ADMITTED) | F.lower(file_name(path)).rlike(NAMED_FILES)) & ~path.rlike(EXCLUDED_DIRS)


def is_generated(path: Column) -> Column:
    return path.rlike("(?i)\\.(g|generated|designer)\\.cs$")


def git_status(code: Column) -> Column:
    """A two-letter porcelain code; the order of the cases matters."""
    c = F.upper(code)
    return (
        F.when(c == "??", "untracked")
        .when(c.contains("U") | c.isin("AA", "DD"), "conflicted")
        .when(c.contains("R"), "renamed")
        .when(c.contains("C"), "copied")
        .when(c.contains("D"), "deleted")
        .when(c.contains("A"), "added")
        .when(c.contains("T"), "type_changed")
        .otherwise("modified")
    )


def route_path(template: Column) -> Column:
    """A request template as a path: no scheme and host, no leading {base}, no query, no outer slashes, no doubles."""
    t = F.regexp_replace(template, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    t = F.regexp_replace(t, "^\\{[^}]*\\}(?=/)", "")
    t = F.regexp_replace(t, "[?#].*$", "")
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(t, "/+", "/"), "^/|/$", ""))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def route_matches(request: Column, endpoint: Column) -> Column:
    """Segment by segment: an endpoint's {parameter} matches all, other segments match ignoring case."""
    pairs = F.arrays_zip(segments(request).alias("r"), segments(endpoint).alias("e"))
    return (F.size(segments(request)) == F.size(segments(endpoint))) & F.forall(pairs, lambda p: p["e"].startswith("{") & p["e"].endswith("}") | (F.lower(p["r"]) == F.lower(p["e"])))


def combined_route(prefix: Column, action: Column, controller: Column, method: Column) -> Column:
    """An action's route: one that starts with a slash overrides the prefix; [controller] and [action] are filled in."""
    action, prefix = F.coalesce(action, F.lit("")), F.coalesce(prefix, F.lit(""))
    raw = F.when(action.startswith("/"), action).otherwise(F.concat_ws("/", F.when(F.trim(prefix) != "", prefix), F.when(F.trim(action) != "", action)))
    name = F.regexp_replace(controller, "Controller$", "")
    quoted = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    filled = F.regexp_replace(F.regexp_replace(raw, F.lit("(?i)\\[controller\\]"), quoted(name)), F.lit("(?i)\\[action\\]"), quoted(method))
    return F.concat(F.lit("/"), F.regexp_replace(F.trim(filled), "^/+|/+$", ""))


_NAME = '"?[A-Za-z_][A-Za-z0-9_]*"?'
SQL_OBJECT = f"(?i)\\b(?:truncate\\s+table|delete\\s+from|into|update|join|from)\\s+({_NAME}(?:\\.{_NAME})?)"


def sql_objects(sql: Column) -> Column:
    """Names after FROM, JOIN, UPDATE, INTO, DELETE FROM, TRUNCATE TABLE: unquoted, lower case, distinct, sorted."""
    names = F.transform(F.regexp_extract_all(sql, F.lit(SQL_OBJECT), F.lit(1)), lambda x: F.lower(F.replace(x, F.lit('"'), F.lit(""))))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "")))


def sql_effect(sql: Column) -> Column:
    """By the word that the text begins with."""
    text = F.upper(F.ltrim(sql))
    begins = lambda *words: text.rlike("^(" + "|".join(words) + ")")
    return F.when(begins("SELECT", "WITH"), "reads").when(begins("INSERT"), "inserts").when(begins("UPDATE"), "writes").when(begins("DELETE"), "deletes").otherwise("executes")


def _both(names: str) -> list[str]:
    return [n + end for n in names.split() for end in ("", "Async")]


EF_EFFECTS = {"reads": _both("Any Count Find First FirstOrDefault LongCount Single SingleOrDefault ToArray ToList"), "inserts": _both("Add AddRange"), "writes": [*_both("ExecuteUpdate"), "Update", "UpdateRange"], "deletes": [*_both("ExecuteDelete"), "Remove", "RemoveRange"]}


def ef_effect(method: Column) -> Column:
    known = F.create_map(*[F.lit(x) for effect, names in EF_EFFECTS.items() for n in names for x in (n, effect)])
    return F.element_at(known, method)


MIGRATION_KINDS = {"CreateTable": "creates", "DropTable": "drops", "RenameTable": "renames", "AddColumn": "adds_column", "AlterColumn": "alters_column", "DropColumn": "drops_column", "CreateIndex": "creates_index", "DropIndex": "drops_index", "AddForeignKey": "adds_foreign_key", "DropForeignKey": "drops_foreign_key"}
TEST_ATTRIBUTES = {"Fact": "xunit", "Theory": "xunit", "Test": "nunit", "TestCase": "nunit", "TestMethod": "mstest", "DataTestMethod": "mstest"}


def lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def access_kind(syntax: Column) -> Column:
    return F.when(syntax.isin("compound", "increment", "decrement", "ref"), "reads_writes").when(syntax.isin("assignment", "out"), "writes").otherwise("reads")


def dispatch_kind(is_extension: Column, is_static: Column, container: Column, is_virtual: Column) -> Column:
    return F.when(is_extension, "extension").when(is_static, "static").when(container == "interface", "interface").when(is_virtual, "virtual").otherwise("direct")


def append_detail(signature: Column, detail: Column) -> Column:
    """`signature | detail`, unless the detail is a segment already."""
    parts = F.filter(F.split(F.coalesce(signature, F.lit("")), "\\s*\\|\\s*"), lambda x: x != "")
    return F.concat_ws(" | ", F.when(F.array_contains(parts, detail), parts).otherwise(F.concat(parts, F.array(detail))))


def authorization(allow_anonymous: Column, policy: Column, roles: Column, authorize: Column) -> Column:
    return F.when(allow_anonymous, "anonymous").when(policy.isNotNull(), F.concat(F.lit("policy:"), policy)).when(roles.isNotNull(), F.concat(F.lit("roles:"), roles)).when(authorize, "authenticated").otherwise("unspecified")


def project_kind(sdk: Column, output: Column, is_test: Column) -> Column:
    return F.when(is_test, "test").when(sdk.contains("Sdk.Web"), "web").when(sdk.contains("Sdk.Worker"), "worker").when(F.lower(output).isin("exe", "winexe"), "application").otherwise("library")


#: In order: what a script's name contains, and its kind.
SCRIPT_KINDS = [("build", "build"), ("test", "test"), ("format|lint", "format"), ("generate|codegen", "generate"), ("package|^pack$", "package"), ("migrate", "migrate")]


def script_kind(name: Column) -> Column:
    return reduce(lambda out, kv: F.when(F.lower(name).rlike(kv[0]), kv[1]).otherwise(out), reversed(SCRIPT_KINDS), F.lit("run"))


def rule_precedence(base: Column, folder: Column) -> Column:
    """Authority of the kind plus 10 for each slash in the folder."""
    return base + 10 * (F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit(""))))


def folded_template(parts: Column) -> Column:
    """A text of its parts (kind, value): text as it is, a hole as {name} ({value} without a name); null if any is neither."""
    one = lambda p: F.when(p["kind"] == "text", p["value"]).when(p["kind"] == "hole", F.concat(F.lit("{"), F.coalesce(p["value"], F.lit("value")), F.lit("}")))
    texts = F.transform(parts, one)
    return F.when(~F.exists(texts, lambda t: t.isNull()), F.array_join(texts, ""))
