"""Configuration documents, read on the driver, and the tables and joins that they turn into.

A document is small; its tables (path rules, arguments, overrides) are joined to artifacts by prefixes that
the artifacts' own paths generate, so every join has equal keys.
"""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.paths import ancestors, any_match
from siftwork.schemas import BY_PREFIX, PATH_RULES

SEVERITIES = ("ERROR", "WARNING", "NOTICE", "NONE")
CATEGORIES = ("BEST_PRACTICES", "CODE_STYLE", "ERROR_PRONE", "PERFORMANCE", "SECURITY")
#: Names under which a configuration file is looked for, in this order.
FILE_NAMES = ("code-security.yaml", "code-security.yml", "static-analysis.yml", "static-analysis.yaml")


class _Loader(yaml.SafeLoader):
    """Rejects repeated keys."""


def _mapping(loader: yaml.SafeLoader, node: yaml.MappingNode) -> dict:
    out: dict = {}
    for k, v in node.value:
        key = loader.construct_object(k, deep=True)
        if key in out:
            raise ValueError(f"repeated key: {key}")
        out[key] = loader.construct_object(v, deep=True)
    return out


_Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)

RULESET_KEYS = {"only-paths", "ignore-paths", "rule-configs", "rules", "ruleset"}
RULE_KEYS = {"only-paths", "ignore-paths", "arguments", "severity", "category"}
SAST_KEYS = {"use-default-rulesets", "use-rulesets", "ignore-rulesets", "ruleset-configs", "global-config"}
GLOBAL_KEYS = {"only-paths", "ignore-paths", "use-gitignore", "ignore-generated-files", "max-file-size-kb"}
V1_KEYS = {"schema-version", "sast", "secrets", "iac", "sca", "iast"}
LEGACY_KEYS = {"schema-version", "rulesets", "only", "only-paths", "ignore", "ignore-paths", "ignore-gitignore", "ignore-generated-files", "max-file-size-kb"}


def _known(value: Any, keys: set[str], where: str) -> dict:
    if value is None:
        return {}
    if not isinstance(value, dict) or set(value) - keys:
        raise ValueError(f"unknown fields in {where}: {value if not isinstance(value, dict) else sorted(map(str, set(value) - keys))}")
    return value


def _by_prefix(value: Any, check: tuple[str, ...] | None = None) -> dict[str, str]:
    """A scalar or a map of path prefixes; '/' and '**' are the root ''."""
    pairs = value if isinstance(value, dict) else {"": value}
    out = {}
    for k, v in pairs.items():
        if isinstance(v, (dict, list)) or v is None:
            raise ValueError(f"not a scalar: {v}")
        text = str(v).lower() if isinstance(v, bool) else str(v)
        if check:
            text = text.upper()
            if text not in check:
                raise ValueError(f"not one of {check}: {v}")
        out["" if k in ("/", "**") else "/".join(x for x in str(k).split("/") if x)] = text
    return out


def _rule(value: Any, where: str) -> dict:
    r = _known(value, RULE_KEYS, where)
    category = r.get("category")
    if category is not None and str(category).upper() not in CATEGORIES:
        raise ValueError(f"unknown category: {category}")
    return {
        "only": r.get("only-paths"), "ignore": r.get("ignore-paths") or [], "category": category and str(category).upper(),
        "arguments": {str(k): _by_prefix(v) for k, v in (r.get("arguments") or {}).items()},
        "severity": _by_prefix(r["severity"], SEVERITIES) if r.get("severity") is not None else {},
    }


def schema_version(text: str) -> str:
    """'legacy' without a version or for v1, 'v1' for v1.N; others are not supported."""
    m = re.search(r"^schema-version:\s*[\"']?([^\"'\s#]+)", text, re.M)
    if not m or m[1] == "v1":
        return "legacy"
    if re.fullmatch(r"v1\.[0-9]+", m[1]):
        return "v1"
    raise ValueError(f"unsupported schema version: {m[1]}")


def parse_config(text: str) -> dict | None:
    """A configuration of either version as one form: use_default, use, ignore_rulesets, rulesets, only, ignore, settings.

    White space alone is no configuration.
    """
    if not text.strip():
        return None
    kind, doc = schema_version(text), yaml.load(text, _Loader)  # noqa: S506  a safe loader
    if kind == "v1":
        doc = _known(doc, V1_KEYS, "the document")
        sast = _known(doc.get("sast"), SAST_KEYS, "sast")
        glob = _known(sast.get("global-config"), GLOBAL_KEYS, "global-config")
        sets = {}
        for name, v in (sast.get("ruleset-configs") or {}).items():
            r = _known(v, RULESET_KEYS - {"ruleset", "rules"}, name)
            sets[name] = {"only": r.get("only-paths"), "ignore": r.get("ignore-paths") or [], "rules": {k: _rule(x, k) for k, x in (r.get("rule-configs") or {}).items()}}
        return {"version": kind, "use_default": sast.get("use-default-rulesets", True), "use": sast.get("use-rulesets") or [], "ignore_rulesets": sast.get("ignore-rulesets") or [], "rulesets": sets, "only": glob.get("only-paths"), "ignore": glob.get("ignore-paths") or [], "use_gitignore": glob.get("use-gitignore", True), "max_file_size_kb": glob.get("max-file-size-kb", 200), "ignore_generated": glob.get("ignore-generated-files", True)}
    doc = _known(doc, LEGACY_KEYS, "the document")
    if not doc.get("rulesets"):
        raise ValueError("rulesets must be a list with an entry")
    sets = {}
    for item in doc["rulesets"]:
        if isinstance(item, str):
            name, value = item, {}
        elif isinstance(item, dict) and len(item) >= 1 and isinstance(next(iter(item)), str):
            name = next(iter(item))
            value = item[name] or {k: v for k, v in item.items() if k != name}
        else:
            raise ValueError(f"not a ruleset: {item}")
        if name in sets:
            raise ValueError(f"repeated ruleset: {name}")
        r = _known({**value, **{k: v for k, v in (item.items() if isinstance(item, dict) else ()) if k != name}}, RULESET_KEYS, name)
        sets[name] = {"only": r.get("only-paths"), "ignore": r.get("ignore-paths") or [], "rules": {k: _rule(x, k) for k, x in (r.get("rules") or {}).items()}}
    only = doc.get("only-paths", doc.get("only"))
    return {"version": kind, "use_default": False, "use": list(sets), "ignore_rulesets": [], "rulesets": sets, "only": only, "ignore": doc.get("ignore-paths") or doc.get("ignore") or [], "use_gitignore": not doc.get("ignore-gitignore", False), "max_file_size_kb": doc.get("max-file-size-kb", 200), "ignore_generated": doc.get("ignore-generated-files", True)}


def check_format(text: str, declared: str) -> None:
    """Raises where text is not of the declared version ('legacy' or 'v1')."""
    if (found := schema_version(text)) != declared:
        raise ValueError(f"schema mismatch: declared {declared}, found {found}")


def local_config(folder: str) -> dict | None:
    """The configuration of a repository's folder: the first of FILE_NAMES of the unified form, else of the legacy form, which is
    upgraded. A file of white space alone counts as none, so the other form is looked for; a folder without any has none."""
    for kind, names in (("v1", FILE_NAMES[:2]), ("legacy", FILE_NAMES[2:])):
        text = next((p.read_text("utf-8") for n in names if (p := Path(folder, n)).is_file()), "")
        if text.strip():
            check_format(text, kind)
            config = parse_config(text)
            return parse_config(yaml.safe_dump(upgrade(config), sort_keys=False)) if kind == "legacy" else config
    return None


def chosen_config(folder: str, remote: str | None = None) -> tuple[dict, str] | None:
    """(configuration, where it is from): remote, the text of a configuration kept elsewhere in the unified form, goes before the
    folder's file; where it cannot be read the file stays. From is 'file', 'remote' or 'remote with file'."""
    local = local_config(folder)
    if remote is not None:
        try:
            check_format(remote, "v1")
            if config := parse_config(remote):
                return config, "remote with file" if local else "remote"
        except (ValueError, yaml.YAMLError):
            pass  # as documented: the file stays
    return (local, "file") if local else None


def upgrade(config: dict) -> dict:
    """A legacy configuration as a v1 document (a mapping to be written as YAML)."""
    glob = {k: v for k, v in (("only-paths", config["only"]), ("ignore-paths", config["ignore"] or None), ("use-gitignore", None if config["use_gitignore"] else False)) if v is not None}
    sets = {}
    for name, r in config["rulesets"].items():
        rules = {}
        for k, x in r["rules"].items():
            named = {"only-paths": x["only"], "ignore-paths": x["ignore"] or None, "arguments": x["arguments"] or None, "severity": x["severity"] or None, "category": x["category"]}
            rules[k] = {a: b for a, b in named.items() if b is not None}
        body = {"only-paths": r["only"], "ignore-paths": r["ignore"] or None, "rule-configs": rules or None}
        if body := {a: b for a, b in body.items() if b is not None}:
            sets[name] = body
    sast = {"use-default-rulesets": False, "use-rulesets": config["use"]} | ({"ruleset-configs": sets} if sets else {}) | ({"global-config": glob} if glob else {})
    return {"schema-version": "v1.0", "sast": sast}


# ---- tables ----


def path_rules(spark: SparkSession, config: dict) -> DataFrame:
    rows = [("global", None, None, k, p) for k in ("only", "ignore") for p in config[k] or []]
    for s, r in config["rulesets"].items():
        rows += [("ruleset", s, None, k, p) for k in ("only", "ignore") for p in r[k] or []]
        rows += [("rule", s, f"{s}/{n}", k, p) for n, x in r["rules"].items() for k in ("only", "ignore") for p in x[k] or []]
    return spark.createDataFrame(rows, PATH_RULES)


def arguments(spark: SparkSession, config: dict) -> DataFrame:
    return spark.createDataFrame([(f"{s}/{n}", p, a, v) for s, r in config["rulesets"].items() for n, x in r["rules"].items() for a, by in x["arguments"].items() for p, v in by.items()], BY_PREFIX)


def severities(spark: SparkSession, config: dict) -> DataFrame:
    return spark.createDataFrame([(f"{s}/{n}", p, "severity", v) for s, r in config["rulesets"].items() for n, x in r["rules"].items() for p, v in x["severity"].items()], BY_PREFIX)


def categories(spark: SparkSession, config: dict) -> DataFrame:
    return spark.createDataFrame([(f"{s}/{n}", x["category"]) for s, r in config["rulesets"].items() for n, x in r["rules"].items() if x["category"]], "rule string, category string")


# ---- joins ----


def rule_applies(path: Column, rule: Column, config: dict) -> Column:
    """Neither the ruleset's nor the rule's restrictions leave the path out; names without an entry apply."""
    out = F.lit(True)

    def restrict(hit: Column, r: dict) -> None:
        nonlocal out
        if r["ignore"]:
            out = out & ~(hit & any_match(path, r["ignore"]))
        if r["only"] is not None:
            out = out & (~hit | any_match(path, r["only"]))

    for s, r in config["rulesets"].items():
        restrict(F.substring_index(rule, "/", 1) == s, r)
        for n, x in r["rules"].items():
            restrict(rule == f"{s}/{n}", x)
    return out


def longest_prefix(artifacts: DataFrame, by_prefix: DataFrame) -> DataFrame:
    """(path, rule, name, value): for each artifact, rule and name the value of the longest prefix of its path.

    Paths generate their prefixes, so this is an equi-join and a grouped maximum.
    """
    up = artifacts.select("path", F.explode(ancestors(F.col("path"))).alias("prefix"))
    hit = up.join(by_prefix, "prefix")
    return hit.groupBy("path", "rule", "name").agg(F.max_by("value", F.length("prefix")).alias("value"))


def rule_arguments(artifacts: DataFrame, by_prefix: DataFrame) -> DataFrame:
    """(path, rule, arguments map)."""
    found = longest_prefix(artifacts, by_prefix)
    return found.groupBy("path", "rule").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("arguments"))


def overridden(findings: DataFrame, severity: DataFrame, category: DataFrame) -> DataFrame:
    """findings (path, rule_name, severity, category) with the overrides of their paths and rules."""
    sev = longest_prefix(findings.select("path").distinct(), severity).select(F.col("path").alias("o_path"), F.col("rule").alias("o_rule"), F.col("value").alias("o_severity"))
    cat = category.select(F.col("rule").alias("c_rule"), F.col("category").alias("o_category"))
    out = findings.join(sev, (F.col("path") == F.col("o_path")) & (F.col("rule_name") == F.col("o_rule")), "left").join(cat, F.col("rule_name") == F.col("c_rule"), "left")
    out = out.withColumns({"severity": F.coalesce("o_severity", "severity"), "category": F.coalesce("o_category", "category")})
    return out.drop("o_path", "o_rule", "o_severity", "c_rule", "o_category")


def used_rulesets(defaults: DataFrame, config: dict) -> DataFrame:
    """Names: the defaults (if used) and those asked for, less the ignored."""
    spark = defaults.sparkSession
    names = lambda x: spark.createDataFrame([(n,) for n in x], "ruleset string")
    start = defaults.select("ruleset") if config["use_default"] else names([])
    return start.unionByName(names(config["use"])).distinct().join(names(config["ignore_rulesets"]), "ruleset", "left_anti")


# ---- documents ----


def ignore_rule(text: str, rule: str) -> str:
    """The document with `**` as the rule's ignored paths."""
    if "/" not in rule:
        if schema_version(text) == "v1":
            raise ValueError(f"not a rule of a ruleset: {rule}")
        return text
    doc, (s, n) = yaml.load(text, _Loader), rule.split("/", 1)  # noqa: S506
    if schema_version(text) == "v1":
        r = doc.setdefault("sast", {}).setdefault("ruleset-configs", {}).setdefault(s, {})
        (r.setdefault("rule-configs", {})).setdefault(n, {})["ignore-paths"] = ["**"]
    else:
        sets = doc.setdefault("rulesets", [])
        at = next((i for i, x in enumerate(sets) if x == s or (isinstance(x, dict) and s in x)), None)
        if at is None:
            sets.append({s: {"rules": {n: {"ignore-paths": ["**"]}}}})
        else:
            entry = sets[at] if isinstance(sets[at], dict) else {s: {}}
            body = entry[s] if isinstance(entry.get(s), dict) else {}
            body.setdefault("rules", {}).setdefault(n, {})["ignore-paths"] = ["**"]
            sets[at] = {s: body}
    return dump(doc, text)


def add_rulesets(text: str, names: list[str], kind: str = "v1") -> str:
    """Appends names that are not there; empty text becomes a document of the kind asked for."""
    if not text.strip():
        fresh = list(dict.fromkeys(names))
        return dump({"schema-version": "v1.0", "sast": {"use-rulesets": fresh}} if kind == "v1" else {"rulesets": fresh}, "")
    doc, have = yaml.load(text, _Loader), rulesets_in(text)  # noqa: S506
    target = doc.setdefault("sast", {}).setdefault("use-rulesets", []) if schema_version(text) == "v1" else doc.setdefault("rulesets", [])
    target += [n for n in dict.fromkeys(names) if n not in have]
    return dump(doc, text)


def rulesets_in(text: str) -> list[str]:
    return parse_config(text)["use"]


def can_onboard(text: str) -> bool:
    c = parse_config(text)
    return not c["only"] and not c["ignore"]


def dump(doc: dict, before: str) -> str:
    """YAML with the comments of `before` that stand above, or at the end of, a line that is still there."""
    out, above, ends = [], {}, {}
    held: list[str] = []
    for line in before.splitlines():
        bare = line.split(" #")[0].rstrip()
        if line.strip().startswith("#") or not line.strip():
            held.append(line)
            continue
        if held:
            above.setdefault(bare.strip(), held)
        held = []
        if " #" in line:
            ends.setdefault(bare.strip(), line[len(bare) :])
    for line in yaml.safe_dump(doc, sort_keys=False).splitlines():
        out += above.pop(line.strip(), [])
        out.append(line + ends.pop(line.strip(), ""))
    return "\n".join([*out, *held]) + "\n"


def config_digest(rules: DataFrame, ignore: list[str], only: list[str] | None, use_gitignore: bool, max_kb: int, subdirectories: list[str], rule_config: str = "", secret_digests: list[str] | None = None) -> DataFrame:
    """One row: hex SHA-256 of what decides results, rules in sorted order (rules: a column `digest`)."""
    head = ":".join([",".join(ignore), ",".join(only or []), str(not use_gitignore).lower()])
    tail = f":{max_kb}::{','.join(subdirectories)}:{rule_config}:{','.join(sorted(secret_digests or []))}"
    joined = F.array_join(F.array_sort(F.collect_list("digest")), ",")
    return rules.agg(F.sha2(F.concat(F.lit(head + ":"), joined, F.lit(tail)), 256).alias("config_digest"))
