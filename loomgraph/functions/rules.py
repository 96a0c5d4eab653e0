"""Predicates of the code graph as column expressions. Lists and patterns are fixed values of the domain."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of edge kinds for impact; all others 0.5.
IMPACT_WEIGHTS = {"CALLS": 1.0, "INHERITS": 0.9, "OVERRIDES": 0.9, "IMPLEMENTS": 0.9, "TESTED_BY": 0.7, "REFERENCES": 0.6, "DEPENDS_ON": 0.6, "IMPORTS_FROM": 0.5, "CONTAINS": 0.3}
# Affinities of edge kinds for communities; all others 0.5.
COMMUNITY_WEIGHTS = {"CALLS": 1.0, "IMPORTS_FROM": 0.5, "INHERITS": 0.8, "IMPLEMENTS": 0.7, "CONTAINS": 0.3, "TESTED_BY": 0.4, "DEPENDS_ON": 0.6}
# Words that mark security-relevant names; the shorter list serves the risk index.
SECURITY = "auth login password token session crypt secret credential permission sql query execute connect socket request http sanitize validate encrypt decrypt hash sign verify admin privilege".split()
RISK_INDEX_WORDS = "auth login password token session crypt secret credential permission sql execute".split()
# Words dropped from a relaxed memory query.
STOP_WORDS = "a an and are as at be by did do does for from had has have how i in is it of on or that the then there they this to was we were what when where which who why will with you".split()
# Names by which frameworks call a function, as one regular expression per family.
ENTRY_NAMES = [
    r"^main$", r"^__main__$", r"^test_", r"^Test[A-Z]", r"^on_", r"^handle_", r"^handler$", r"^handle$", r"^lambda_handler$", r"^upgrade$", r"^downgrade$",
    r"^lifespan$", r"^get_db$", r"^on(Create|Start|Resume|Pause|Stop|Destroy|Bind|Receive)", r"^do(Get|Post|Put|Delete)$",
    r"^do_(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)$", r"^log_message$", r"^(middleware|errorHandler)$",
    r"^ng(OnInit|OnChanges|OnDestroy|DoCheck|AfterContentInit|AfterContentChecked|AfterViewInit|AfterViewChecked)$",
    r"^(transform|writeValue|registerOnChange|registerOnTouched|setDisabledState)$", r"^(canActivate|canDeactivate|canActivateChild|canLoad|canMatch|resolve)$",
    r"^(componentDidMount|componentDidUpdate|componentWillUnmount|shouldComponentUpdate|render)$",
]
PHP_ENTRY_NAMES = [r"^(boot|register)$", r"^__invoke$"]
# Decorators by which frameworks register a function.
ENTRY_DECORATORS = [
    r"(?i)app\.(get|post|put|delete|patch|route|websocket|on_event)", r"(?i)router\.(get|post|put|delete|patch|route)", r"(?i)blueprint\.(route|before_request|after_request)",
    r"(?i)(before|after)_(request|response)", r"(?i)click\.(command|group)", r"(?i)\w+\.(command|group)\b", r"(?i)(field|model)_(serializer|validator)",
    r"(?i)(celery\.)?(task|shared_task|periodic_task)", r"(?i)receiver", r"(?i)api_view", r"(?i)\baction\b", r"pytest\.(fixture|mark)", r"(?i)(override_settings|modify_settings)",
    r"(?i)(event\.)?listens_for", r"(?i)(Get|Post|Put|Delete|Patch|RequestMapping)Mapping", r"(?i)(Scheduled|EventListener|Bean|Configuration)", r"(?i)KafkaListener",
    r"(?i)(WorkflowMethod|ActivityMethod)", r"(?i)(Component|Injectable|Controller|Module|Guard|Pipe)", r"(?i)(Subscribe|Mutation|Query|Resolver)",
    r"(app|router)\.(get|post|put|delete|patch|use|all)\b", r"(?i)@(Override|OnLifecycleEvent|Composable)", r"(?i)(HiltViewModel|AndroidEntryPoint|Inject)",
    r"(?i)\w+\.(tool|tool_plain|system_prompt|result_validator)\b", r"^tool\b", r"(?i)\w+\.(middleware|exception_handler|on_exception)\b", r"(?i)\w+\.route\b",
]
# Languages whose call edges may name each other's symbols.
SCRIPT_FAMILY = ("javascript", "typescript", "tsx")
# Paths that a build ignores; a leading slash anchors a pattern at the root of a checkout.
IGNORED_GLOBS = [
    "**/node_modules/**", "**/.git/**", "**/.svn/**", "**/__pycache__/**", "*.pyc", "**/.venv/**", "**/venv/**", "/dist/**", "/build/**", "/.next/**", "/.nuxt/**", "/target/**", "/bin/**", "/obj/**",
    "**/vendor/**", "/storage/**", "/bootstrap/cache/**", "/public/build/**", "**/.bundle/**", "**/.gradle/**", "*.jar", "**/.dart_tool/**", "**/.pub-cache/**", "**/cdk.out/**", "/coverage/**", "**/.cache/**", "/.tmp/**", "/tmp/**",
    "*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json", "yarn.lock", "*.db", "*.sqlite", "*.db-journal", "*.db-wal",
]
# Files that hold declarations only.
DECLARATION_GLOBS = ["*.d.ts", "*.d.mts", "*.d.cts"]
# Names of built-in functions, whose callers nobody asks for.
BUILTIN_CALLS = """map filter reduce reduceRight forEach find findIndex some every includes indexOf lastIndexOf push pop shift unshift splice slice
concat join flat flatMap sort reverse fill keys values entries from isArray of at trim trimStart trimEnd split replace replaceAll match matchAll search substring substr
toLowerCase toUpperCase startsWith endsWith padStart padEnd repeat charAt charCodeAt assign freeze defineProperty getOwnPropertyNames hasOwnProperty create is fromEntries
log warn error info debug trace dir table time timeEnd assert clear count then catch finally resolve reject all allSettled race any parse stringify
floor ceil round random max min abs pow sqrt addEventListener removeEventListener querySelector querySelectorAll getElementById createElement appendChild removeChild
setAttribute getAttribute preventDefault stopPropagation setTimeout clearTimeout setInterval clearInterval toString valueOf toJSON toISOString getTime getFullYear now
isNaN parseInt parseFloat toFixed encodeURIComponent decodeURIComponent call apply bind next emit on off once pipe write read end close destroy send status json redirect
set get delete has findUnique findFirst findMany createMany update updateMany deleteMany upsert aggregate groupBy transaction
describe it test expect beforeEach afterEach beforeAll afterAll mock spyOn require fetch""".split()


def any_of(patterns: list[str]) -> str:
    """One alternation of patterns; flags at the front of a pattern hold for it alone."""
    return "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns)


def glob_regex(glob: str) -> str:
    """An ignore glob as a regular expression over a path below the root: **/x/** names a folder anywhere, /x/** a folder at the root, x/** a folder anywhere, a/b/** a folder at the root; any other pattern covers the whole path, and its star crosses slashes."""
    if glob.startswith("**/") and glob.endswith("/**"):
        return rf"(?:^|/){re.escape(glob[3:-3])}(?:/|$)"
    if glob.endswith("/**"):
        folder = glob[:-3].strip("/")
        start = "^" if glob.startswith("/") or "/" in folder else "(?:^|/)"
        return rf"{start}{re.escape(folder)}(?:/|$)"
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob.lstrip("/")) + "$"


def ignored(path: Column, globs: list[str] | None = None) -> Column:
    """Whether a path below its root matches one of the ignore globs, those of declaration files among them."""
    return path.rlike("|".join(glob_regex(g) for g in (IGNORED_GLOBS + DECLARATION_GLOBS if globs is None else globs)))


def language_family(language: Column) -> Column:
    """The languages that count as one, under one name."""
    return F.when(language.isin(*SCRIPT_FAMILY), F.lit("javascript")).otherwise(language)


def entry_name(name: Column, language: Column) -> Column:
    """Whether a function is called by a framework, by its name."""
    return name.rlike(any_of(ENTRY_NAMES)) | ((language == "php") & name.rlike(any_of(PHP_ENTRY_NAMES)))


def decorators(extra: Column) -> Column:
    """Decorators of a node; broken or missing JSON has none."""
    return F.coalesce(F.from_json(F.get_json_object(extra, "$.decorators"), "array<string>"), F.array().cast("array<string>"))


def framework_decorator(extra: Column) -> Column:
    """Whether a decorator registers the node with a framework."""
    return F.exists(decorators(extra), lambda d: d.rlike(any_of(ENTRY_DECORATORS)))


def security(name: Column, qualified: Column, words: list[str] | None = None) -> Column:
    """Whether a name holds a security word."""
    r = "|".join(SECURITY if words is None else words)
    return F.lower(name).rlike(r) | F.lower(qualified).rlike(r)


def weight(kind: Column, weights: dict[str, float], default: float = 0.5) -> Column:
    """The weight of an edge kind."""
    c = F.lit(default)
    for k, w in weights.items():
        c = F.when(kind == k, F.lit(w)).otherwise(c)
    return c


def split_words(name: Column) -> Column:
    """Words of a camelCase or snake_case name."""
    return F.filter(F.split(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"), r"[_\-.\s]+"), lambda w: w != "")


def clean(text: Column, limit: int = 256) -> Column:
    """Control characters aside, at most `limit` characters."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]", ""), 1, limit)


def signature(kind: Column, name: Column, params: Column, returns: Column) -> Column:
    """def n(p) -> r, class n, or the name, at most 512 characters."""
    p = F.regexp_replace(F.coalesce(params, F.lit("")), r"^\(|\)$", "")
    f = F.concat(F.lit("def "), name, F.lit("("), p, F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), returns), F.lit("")))
    return F.substring(F.when(kind.isin("Function", "Test"), f).when(kind == "Class", F.concat(F.lit("class "), name)).otherwise(name), 1, 512)


def file_kind(path: Column) -> Column:
    """docs, config, code or other, by the name of a file."""
    n = F.lower(F.substring_index(path, "/", -1))
    return (
        F.when(n.rlike(r"^(dockerfile|makefile|requirements[^.]*|package|tsconfig|setup)(\.|$)"), "config").when(n.rlike(r"\.(md|rst|txt|adoc|mdx)$"), "docs")
        .when(n.rlike(r"\.(json|ya?ml|toml|ini|cfg|lock|xml|properties|env)$") | n.startswith("."), "config")
        .when(n.rlike(r"\.(py|js|jsx|ts|tsx|java|go|rs|rb|php|c|cc|cpp|h|hpp|cs|kt|swift|scala|sh|sql)$"), "code").otherwise("other")
    )
