"""Column expressions that the graph operators share; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
#: Trust of a derivation class in aggregations; others count 0.
AGGREGATION_PRIORITY = {"authoritative_declared": 5, "runtime_observed": 4, "deterministic_static": 3, "manual_override": 2, "inferred_llm": 1}
#: Segments that mark a directory of tests.
TEST_DIRECTORIES = ("test", "tests", "spec", "specs", "__tests__")


def canonical(status: Column) -> Column:
    """A missing status means canonical."""
    return F.coalesce(status, F.lit("canonical")) == "canonical"


def stable_hash(*parts: Column) -> Column:
    """The first 24 hex digits of a digest over the parts; a missing part counts as the word None."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return F.substring(F.sha2(text, 256), 1, 24)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of the fields by name, without blanks and in ASCII alone; missing values are null."""
    raw = F.to_json(F.struct(*(fields[n].alias(n) for n in sorted(fields))), {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"})
    # Escapes are wanted in lower case; a \\u that itself is escaped is none.
    parts = F.split(raw, r"(?<=(?<!\\)(?:\\\\){0,99}\\u)")
    lower = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lower(F.substring(p, 1, 4)), F.substr(p, F.lit(5)))))
    return F.replace(F.array_join(lower, ""), F.lit("\x7f"), F.lit("\\u007f"))


def urn_part(value: Column) -> Column:
    """Percent-encodes a trimmed identity field, leaving no character safe but unreserved ones; null if blank."""
    trimmed = F.trim(value)
    encoded = F.replace(F.replace(F.replace(F.url_encode(trimmed), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(F.length(trimmed) > 0, encoded)


def urn(scheme: str, kind: str, fallback: Column, *fields: Column) -> Column:
    """scheme://kind/field/field..., or the fallback hash where a field is missing."""
    parts = [urn_part(f) for f in fields]
    whole = F.concat(F.lit(f"{scheme}://{kind}/"), F.array_join(F.array(*parts), "/"))
    missing = F.exists(F.array(*parts), lambda p: p.isNull())
    return F.when(missing, F.concat(F.lit(f"{scheme}://{kind}/"), fallback)).otherwise(whole)


def is_hash_urn(value: Column) -> Column:
    return value.rlike("/[0-9a-f]{24}$")


def package_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[-_.]+", "-")


def endpoint_path(path: Column) -> Column:
    """Quotes and blanks stripped, one leading slash; full URLs stay."""
    bare = F.regexp_replace(F.trim(path), "^[\"'`]+|[\"'`]+$", "")
    return F.when(bare.rlike("^https?://"), bare).when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(F.lit("/"), bare))


def path_shape(path: Column) -> Column:
    """Parameter segments of any notation become {param}; empty segments go."""
    name = r"[\p{L}_][\p{L}\p{N}_-]*"
    named = rf"^:{name}(\(.*\))?\??$"
    typed = rf"^<\s*(.*:\s*)?{name}\s*>$"
    braced = rf"^\{{\s*(\*\s*)?{name}\s*(:.*)?\}}$"
    segments = F.filter(F.split(endpoint_path(path), "/"), lambda s: s != "")
    shaped = F.transform(segments, lambda s: F.when(s.rlike(named) | s.rlike(typed) | s.rlike(braced), F.lit("{param}")).otherwise(s))
    return F.when(path.rlike("^https?://"), path).otherwise(F.concat(F.lit("/"), F.array_join(shaped, "/")))


def shape_has_prefix(shape: Column, prefix: Column) -> Column:
    bare = F.rtrim(prefix, F.lit("/"))
    return (shape == prefix) | F.startswith(shape, F.concat(bare, F.lit("/")))


def dotted_prefix(name: Column, depth: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(name, "[.]"), lambda s: s != ""), 1, max(1, depth)), ".")


def loose_path(path: Column) -> Column:
    """Backslashes turned, and any leading run of dots and slashes dropped."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def strict_path(path: Column) -> Column:
    """Backslashes turned, and leading ./ dropped; leading dots of a name stay."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def is_test_path(path: Column) -> Column:
    segments = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    name = F.element_at(segments, -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    marked = F.arrays_overlap(F.slice(segments, 1, F.size(segments) - 1), F.array(*map(F.lit, TEST_DIRECTORIES)))
    return marked | stem.rlike("^(test|spec)_|_(test|spec)$") | name.rlike(r"\.(test|spec)\.")


def repo_matches(left: Column, right: Column) -> Column:
    """Equal, or equal by bare name where at most one side names an owner."""
    bare = F.element_at(F.split(left, "/"), -1) == F.element_at(F.split(right, "/"), -1)
    return (left == right) | (bare & ~(F.contains(left, F.lit("/")) & F.contains(right, F.lit("/"))))


def display(prefix: str = "") -> Column:
    """What an entity is called in results; one rule for each kind."""
    c = lambda name: F.col(prefix + name)
    return (
        F.when(c("kind") == "CodeSymbol", F.concat_ws(".", c("module"), c("qualname")))
        .when(c("kind") == "CodeModule", c("module"))
        .when(c("kind") == "ExternalSymbol", F.concat_ws(".", c("module"), c("name")))
        .when(c("kind") == "Endpoint", F.concat_ws(" ", c("host"), c("method"), c("path")))
        .when(c("kind") == "EventChannel", F.concat_ws(":", c("broker_kind"), F.coalesce(c("channel_address"), c("name"))))
        .when(c("kind") == "DeployTarget", F.concat_ws(":", c("type"), c("target")))
        .otherwise(F.coalesce(c("name"), c("slug"), c("entity_id")))
    )


def derivation_priority(column: Column) -> Column:
    out = F.lit(0)
    for name, value in AGGREGATION_PRIORITY.items():
        out = F.when(column == name, value).otherwise(out)
    return out


def domain_of(value: Column) -> Column:
    """A host name from a URL, host:port or bare domain; null if it is none."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(value), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/@]*@)?", ""), r"[:/?#].*$", ""))
    label = r"[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
    return F.when(bare.rlike(rf"^({label}\.)+[a-z]{{2,63}}$") & (F.length(bare) <= 253), bare)


def queue_of_arn(arn: Column) -> Column:
    """The queue's name of a well-formed SQS ARN, else null."""
    return F.when(arn.rlike(r"^arn:aws[a-z-]*:sqs:[a-z0-9-]+:[0-9]{12}:[A-Za-z0-9_-]{1,75}(\.fifo)?$"), F.element_at(F.split(arn, ":"), 6))


def topic_of_arn(arn: Column) -> Column:
    """The topic's name of a well-formed SNS ARN, else null."""
    return F.when(arn.rlike(r"^arn:aws[a-z-]*:sns:[a-z0-9-]+:[0-9]{12}:[A-Za-z0-9_-]{1,251}(\.fifo)?$"), F.element_at(F.split(arn, ":"), 6))


def git_url(url: Column) -> Column:
    """host, owner and name of a repository URL in its common forms, as a struct; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), r"^git\+", ""), r"^github:", "https://github.com/"), r"(\.git)?/?(#.*)?$", "")
    pattern = r"^(?:[a-z]+://(?:[^@/]*@)?|(?:[^@/]+@))([^/:]+)(?::[0-9]+)?[:/](.+)/([^/]+)$"
    part = lambda k: F.regexp_extract(bare, pattern, k)
    return F.when(bare.rlike(pattern), F.struct(F.lower(part(1)).alias("host"), part(2).alias("owner"), part(3).alias("name")))


def identifier_words(name: Column) -> Column:
    """Lower-case words of a camelCase or snake_case identifier."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), 0), lambda w: F.lower(w))
