"""Path predicates and path arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which paths are source, configuration, tests, and evidence that may be shown.
CODE_EXT = "ts|tsx|mts|cts|js|jsx|mjs|cjs"
STYLE_EXT = "css|scss|sass|less"
CODE = rf"\.(?:{CODE_EXT})$"
STYLE = rf"\.(?:{STYLE_EXT})$"
JSX = r"\.(?:tsx|jsx)$"
PACKAGE_JSON = r"(^|/)package\.json$"
CONFIG = (
    PACKAGE_JSON,
    r"(^|/)tsconfig(?:\.[^/]+)?\.json$",
    r"(^|/)jsconfig\.json$",
    r"(^|/)(?:next|vite|remix|tailwind|postcss|vitest)\.config\.(?:ts|tsx|js|jsx|mjs|cjs)$",
)
#: The committed configuration of a repository: roots with their adapters and protocols.
CONFIG_FILE = "wakeline.config.json"
CONFIG_NAMES = ("pnpm-workspace.yaml", "turbo.json", "nx.json", CONFIG_FILE)
TOOLING = (r"(^|/)(?:drizzle|next|tailwind|postcss|eslint|prettier|vite|vitest|remix)\.config\.(?:ts|js|mjs|cjs)$", r"(^|/)sentry\..+\.config\.(?:ts|js|mjs|cjs)$")
DENIED = (
    r"(^|/)(?:\.env|env)(?:\.|/|$)",
    r"(?:lock\.json|package-lock\.json|pnpm-lock\.yaml|yarn\.lock)$",
    r"(^|/)(?:node_modules|dist|build|\.next|generated)(?:/|$)",
    r"(^|/)(?:scripts|drizzle|config|server|db|database|migrations?|infra(?:structure)?|adapters?|providers?)(?:/|$)",
    r"(?:^|/)(?:next|tailwind|postcss|eslint|prettier|vite|vitest)\.config\.",
)
SHOWN = r"\.(?:ts|tsx|js|jsx|mjs|cjs|css|scss|sass|less)$"
TEST_DIR = r"(?:^|/)(?:__tests__|tests?|e2e|cypress|playwright|stories)(?:/|$)"
TEST_FILE = r"\.(?:test|spec|stories)\.(?:ts|tsx|js|jsx|mjs|cjs)$"


def is_source(path: Column) -> Column:
    """a graph source file."""
    return path.rlike(CODE) | path.rlike(STYLE)


def is_config(path: Column) -> Column:
    """a file that configures projects or resolution."""
    out = path.isin(*CONFIG_NAMES)
    for pattern in CONFIG:
        out = out | path.rlike(pattern)
    return out


def is_under(path: Column, root: Column) -> Column:
    """the path is the root or lies below it; the empty root holds everything."""
    return (root == "") | (path == root) | path.startswith(F.concat(root, F.lit("/")))


def glob_pattern(glob: Column) -> Column:
    """an anchored pattern for a workspace glob; ``*`` stays in a segment, ``**`` doesn't."""
    escaped = F.regexp_replace(normalize_root(glob), r"([.+?^${}()|\[\]\\])", r"\\$1")
    deep = F.replace(escaped, F.lit("**"), F.lit("\u0001"))
    return F.concat(F.lit("^"), F.replace(F.replace(deep, F.lit("*"), F.lit("[^/]+")), F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def matches_glob(root: Column, glob: Column) -> Column:
    return F.regexp_like(root, glob_pattern(glob))


def is_tooling(path: Column) -> Column:
    return path.startswith("scripts/") | path.rlike(TOOLING[0]) | path.rlike(TOOLING[1])


def is_shown(path: Column) -> Column:
    """evidence from the path may be shown."""
    lower = F.lower(path)
    out = lower.rlike(SHOWN)
    for pattern in DENIED:
        out = out & ~lower.rlike(pattern)
    return out


def is_test(path: Column) -> Column:
    """F12."""
    return path.rlike(TEST_DIR) | path.rlike(TEST_FILE)


def normalize_root(path: Column) -> Column:
    """Forward slashes, no leading ``./``, no slashes around; ``.`` is the empty root."""
    out = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", ""), "^/+|/+$", "")
    return F.when(out == ".", "").otherwise(out)


def dirname(path: Column) -> Column:
    """All before the last slash, else the empty root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def join_root(root: Column, path: Column) -> Column:
    return F.when(root == "", path).otherwise(F.concat(root, F.lit("/"), path))


def relative(root: Column, path: Column) -> Column:
    return F.when(root == "", path).otherwise(F.substring(path, F.length(root) + 2, F.length(path)))


def normalize(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute or relative path; ``..`` stops at the top."""
    segments = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    return F.array_join(kept, "/")


def prefixes(path: Column) -> Column:
    """Every ancestor directory of a path and the empty root, as candidates of an equi-join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def join_route(base: Column, part: Column) -> Column:
    """Both parts' non-empty segments behind one leading slash."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(F.concat_ws("/", base, part), "/"), lambda s: s != ""), "/"))


def next_route(local: Column) -> Column:
    """Route of a file-convention path: groups and slots vanish, ``[x]`` and ``[...x]`` become parameters."""

    def parameter(s: Column) -> Column:
        deep, one = F.regexp_extract(s, r"^\[\.\.\.(.+)\]$", 1), F.regexp_extract(s, r"^\[(.+)\]$", 1)
        return F.when(deep != "", F.concat(F.lit(":"), deep, F.lit("*"))).when(one != "", F.concat(F.lit(":"), one)).otherwise(s)

    kept = F.filter(F.split(local, "/"), lambda s: ~s.rlike(r"^\(.+\)$") & ~s.startswith("@"))
    return join_route(F.lit(""), F.array_join(F.transform(kept, parameter), "/"))


def remix_route(local: Column) -> Column:
    """Dots separate segments, a trailing ``_index`` vanishes, ``$x`` is a parameter."""
    parts = F.filter(F.split(F.regexp_replace(local, r"(?:^|\.)_index$", ""), r"\."), lambda s: s != "")
    named = F.transform(parts, lambda s: F.when(s.startswith("$"), F.concat(F.lit(":"), F.substring(s, 2, 10_000))).otherwise(s))
    return join_route(F.lit(""), F.array_join(named, "/"))


APP_ROUTE = rf"^(?:src/)?app/(?:(.*)/)?(page|route)\.(?:{CODE_EXT})$"
PAGES_ROUTE = rf"^(?:src/)?pages/(.*)\.(?:{CODE_EXT})$"
REMIX_ROUTE = rf"^app/routes/(.+)\.(?:{CODE_EXT})$"


def pages_route(name: Column) -> Column:
    """An api path loses its ``api/``; ``index`` stays as it is."""
    return next_route(F.when(name.startswith("api/"), F.substr(name, F.lit(5))).otherwise(name))


def package_of(specifier: Column) -> Column:
    """The package a specifier names; scoped packages have two segments."""
    return F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def import_hints(path: Column) -> Column:
    """The last path part and the one before, where they have more than two characters and say something."""
    bare = F.regexp_replace(F.lower(path), r"\.(?:ts|tsx|js|jsx|mjs|cjs)$", "")
    parts = F.filter(F.split(bare, "/"), lambda s: (s != "") & ~s.isin("src", "index"))
    last = F.array(F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2)))
    return F.array_distinct(F.filter(last, lambda s: F.length(s) > 2))


def branch_of(ref: Column) -> Column:
    """The branch a ref names, null for other refs."""
    return F.when(ref.startswith("refs/heads/"), F.substring(ref, 12, 10_000))


def is_zero_sha(sha: Column) -> Column:
    """the sha that stands for a deleted branch."""
    return sha.rlike("^0+$")
