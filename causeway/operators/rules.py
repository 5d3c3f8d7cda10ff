"""Architecture rules over folder and file graphs.

Layers, rules and exemptions are short ordered lists on the driver; globs become
column predicates, so every rule is one narrow pass over the edges with a literal
prefix test in front of its regex, and first-match order is a CASE. No edge is
joined with a list.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.globs import matches, matches_any, to_regex
from causeway.model import ConfigError


# The wording of findings, which scripts may compare.
LAYER_MESSAGE = 'layer "%s" may not depend on layer "%s": %s -> %s'
EDGE_MESSAGE = "forbidden edge: %s -> %s"
CYCLE_MESSAGE = "%s cycle: %s"


@dataclass(frozen=True)
class Layer:
    name: str
    match: tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    id: str
    type: str
    rationale: str
    level: str | None = None
    src: tuple[str, ...] = ()
    dst: tuple[str, ...] = ()
    ignore_type_imports: bool = False
    fix: str | None = None


@dataclass(frozen=True)
class Exemption:
    rule: str
    src: str
    dst: str
    reason: str


@dataclass(frozen=True)
class RuleSet:
    layers: tuple[Layer, ...] = ()
    rules: tuple[Rule, ...] = ()
    exemptions: tuple[Exemption, ...] = ()


@dataclass
class CheckResult:
    """Edge and cycle violations, and what the rule file says in vain."""

    violations: DataFrame
    unused_exemptions: list[Exemption] = field(default_factory=list)
    dead_patterns: list[tuple[str, str]] = field(default_factory=list)

    @property
    def clean(self) -> bool:
        return self.violations.isEmpty()


def _text(value, where: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ConfigError(f"{where} must be a non-empty string")
    return value.strip()


def _globs(value, where: str) -> tuple[str, ...]:
    values = [value] if isinstance(value, str) else value
    if not isinstance(values, list) or not values:
        raise ConfigError(f"{where} must be a glob or a non-empty list of globs")
    found = tuple(_text(v, where) for v in values)
    for g in found:
        to_regex(g)
    return found


def parse_rule(raw, where: str = "rule") -> Rule:
    if not isinstance(raw, dict):
        raise ConfigError(f"{where} must be a mapping")
    name = _text(raw.get("id"), f"{where}.id")
    kind, why = raw.get("type"), _text(raw.get("rationale"), f"{name}.rationale")
    ignore = raw.get("ignore-type-imports") is True
    if kind == "no-cycles":
        level = {"package": "folder"}.get(raw.get("level"), raw.get("level"))
        if level not in ("folder", "file"):
            raise ConfigError(f"{name}.level must be folder or file")
        return Rule(name, kind, why, level=level)
    if kind == "layer-order":
        return Rule(name, kind, why, ignore_type_imports=ignore)
    if kind == "forbidden-edge":
        fix = raw.get("fix")
        return Rule(name, kind, why, src=_globs(raw.get("from"), f"{name}.from"), dst=_globs(raw.get("to"), f"{name}.to"), ignore_type_imports=ignore, fix=None if fix is None else _text(fix, f"{name}.fix"))
    raise ConfigError(f"{name}: unknown rule type {kind!r}")


def parse_rule_set(text: str) -> RuleSet:
    import yaml

    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"rules aren't valid YAML: {e}") from e
    if not isinstance(raw, dict):
        raise ConfigError("rules must be a mapping")
    if raw.get("version") != 1 or isinstance(raw.get("version"), bool):
        raise ConfigError("version must be 1")
    for name in ("layers", "rules", "exemptions"):
        if raw.get(name) is not None and not isinstance(raw[name], list):
            raise ConfigError(f"{name} must be a list")
    layers = tuple(Layer(_text(x.get("name") if isinstance(x, dict) else None, "layer name"), _globs(x.get("match"), "layer match")) for x in raw.get("layers") or [])
    rules = tuple(parse_rule(x, f"rules[{i}]") for i, x in enumerate(raw.get("rules") or []))
    if not rules:
        raise ConfigError("rules must not be empty")
    if any(r.type == "layer-order" for r in rules) and not layers:
        raise ConfigError("a layer-order rule needs layers")
    exemptions = []
    for x in raw.get("exemptions") or []:
        if not isinstance(x, dict):
            raise ConfigError("an exemption must be a mapping")
        rule = _text(x.get("rule"), "exemption rule")
        if rule not in {r.id for r in rules}:
            raise ConfigError(f"exemption for unknown rule {rule}")
        ends = [_text(x.get(k, "**"), f"exemption {k}") for k in ("from", "to")]
        for g in ends:
            to_regex(g)
        exemptions.append(Exemption(rule, *ends, _text(x.get("reason"), "exemption reason")))
    return RuleSet(layers, rules, tuple(exemptions))


def load_rule_set(path: str) -> RuleSet:
    try:
        with open(path, encoding="utf-8") as f:
            return parse_rule_set(f.read())
    except OSError as e:
        raise ConfigError(f"can't read {path}: {e}") from e


def layer_of(column: Column, layers: tuple[Layer, ...]) -> Column:
    """Index of the first layer with a matching glob; -1 for none."""
    out = F.lit(-1)
    for i in reversed(range(len(layers))):
        out = F.when(matches_any(column, list(layers[i].match)), i).otherwise(out)
    return out


def edge_violations(rule: Rule, edges: DataFrame, layers: tuple[Layer, ...] = ()) -> DataFrame:
    """(rule, src, dst, kind, line, message, fix) of a layer-order or forbidden-edge rule."""
    rows = edges.where(F.col("kind") != "type") if rule.ignore_type_imports else edges
    if rule.type == "layer-order":
        names = F.array(*[F.lit(x.name) for x in layers])
        rows = rows.withColumn("a", layer_of(F.col("src"), layers)).withColumn("b", layer_of(F.col("dst"), layers)).where("a >= 0 AND b > a")
        message = F.format_string(LAYER_MESSAGE, F.get(names, F.col("a")), F.get(names, F.col("b")), "src", "dst")
    else:
        rows = rows.where(matches_any(F.col("src"), list(rule.src)) & matches_any(F.col("dst"), list(rule.dst)))
        message = F.format_string(EDGE_MESSAGE, "src", "dst")
    return rows.select(F.lit(rule.id).alias("rule"), "src", "dst", "kind", "line", message.alias("message"), F.lit(rule.fix).cast("string").alias("fix"))


def cycle_violations(rule: Rule, cycles: DataFrame) -> DataFrame:
    """(rule, cycle, message)."""
    message = F.format_string(CYCLE_MESSAGE, F.lit(rule.level), F.array_join("nodes", " <-> "))
    return cycles.select(F.lit(rule.id).alias("rule"), F.col("nodes").alias("cycle"), message.alias("message"))


def exempted_by(exemptions: tuple[Exemption, ...]) -> Column:
    """Position of the first exemption that covers a violation (rule, src, dst); null for none."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(exemptions))):
        e = exemptions[i]
        out = F.when((F.col("rule") == e.rule) & matches(F.col("src"), e.src) & matches(F.col("dst"), e.dst), i).otherwise(out)
    return out


def dead_patterns(rules: RuleSet, files: DataFrame) -> list[tuple[str, str]]:
    """(owner, glob) of globs that match no file, in order; all are counted in one pass."""
    owned = [(f"layer {x.name}", g) for x in rules.layers for g in x.match]
    owned += [(f"rule {r.id}", g) for r in rules.rules if r.type == "forbidden-edge" for g in (*r.src, *r.dst)]
    if not owned:
        return []
    row = files.agg(*[F.bool_or(matches(F.col("id"), g)).alias(f"m{i}") for i, (_, g) in enumerate(owned)]).first()
    return [x for i, x in enumerate(owned) if not row[f"m{i}"]]


def check(rules: RuleSet, files: DataFrame, file_edges: DataFrame, cycles_of: dict[str, DataFrame]) -> CheckResult:
    """All rules: violations (ord, rule, severity, rationale, src, dst, kind, line, cycle, message, fix), unused exemptions, dead patterns."""
    out = None
    for i, rule in enumerate(rules.rules):
        if rule.type == "no-cycles":
            rows = cycle_violations(rule, cycles_of[rule.level])
        else:
            rows = edge_violations(rule, file_edges, rules.layers).withColumn("exempt", exempted_by(rules.exemptions))
        rows = rows.withColumn("ord", F.lit(i)).withColumn("severity", F.lit("error")).withColumn("rationale", F.lit(rule.rationale))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    for name, kind in (("exempt", "int"), ("src", "string"), ("dst", "string"), ("kind", "string"), ("line", "int"), ("cycle", "array<string>"), ("fix", "string")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    used = {r["exempt"] for r in out.where("exempt IS NOT NULL").select("exempt").distinct().collect()} if rules.exemptions else set()
    kept = out.where("exempt IS NULL").select("ord", "rule", "severity", "rationale", "src", "dst", "kind", "line", "cycle", "message", "fix")
    return CheckResult(kept, [e for i, e in enumerate(rules.exemptions) if i not in used], dead_patterns(rules, files))
