"""Feature configuration: a dict (as of YAML or JSON) to typed specifications, and a plan of states and features from them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from rankweave.functions.scalar import duration_ms

#: Kinds of feature by type.
TYPES = ("number", "boolean", "string", "vector", "word_count", "rate", "interaction_count", "window_count", "interacted_with", "ua", "referer", "relevancy", "local_time", "item_age", "field_match", "diversity", "position", "random")
_SCOPE = re.compile(r"^(global|item|user|session|ranking|(?:item|ranking)\.[A-Za-z_][\w-]*)$")
_FIELD = re.compile(r"^(?:(item|metadata|user|ranking|\*)\.|interaction:([^.]+)\.)(.+)$")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class FieldRef:
    """Where a field comes from: the kind of event (interaction with its type), and its name."""

    event: str
    name: str
    type: str | None = None


@dataclass(frozen=True)
class Feature:
    name: str
    type: str
    scope: str
    source: FieldRef | None = None
    refresh_ms: int = 0
    ttl_ms: int = 90 * 86_400_000
    options: dict = field(default_factory=dict, compare=False)


def field_ref(text: str) -> FieldRef:
    """item.x (or metadata.x), user.x, ranking.x, interaction:type.x, *.x"""
    m = _FIELD.match(text)
    if not m:
        raise ConfigError(f"not a field reference: {text}")
    if m[2]:
        return FieldRef("interaction", m[3], m[2])
    return FieldRef({"metadata": "item"}.get(m[1], m[1]), m[3])


def feature(spec: dict) -> Feature:
    kind = spec.get("type")
    if kind not in TYPES:
        raise ConfigError(f"unknown type of feature: {kind}")
    if not spec.get("name"):
        raise ConfigError("a feature needs a name")
    scope = spec.get("scope", "item")
    if not _SCOPE.match(scope):
        raise ConfigError(f"unknown scope: {scope}")
    source = spec.get("source") or (spec.get("field") if isinstance(spec.get("field"), str) else None)
    known = {"name", "type", "scope", "source", "refresh", "ttl"}
    reference = field_ref(source) if isinstance(source, str) and _FIELD.match(source) else None
    return Feature(spec["name"], kind, scope, reference, duration_ms(spec.get("refresh", "1h" if kind == "rate" else "0s")), duration_ms(spec.get("ttl", "90d")), {k: v for k, v in spec.items() if k not in known})


@dataclass(frozen=True)
class Plan:
    features: dict[str, Feature]
    models: dict[str, dict]

    def width(self, model: str) -> dict[str, tuple[int, int]]:
        """Offset and size in the matrix of each feature of a model, in the model's order."""
        at, out = 0, {}
        for name in self.models[model].get("features", []):
            size = dimension(self.features[name])
            out[name] = (at, size)
            at += size
        return out


def dimension(f: Feature) -> int:
    """Numbers that a feature gives."""
    o = f.options
    if f.type in ("rate", "window_count"):
        return len(o["periods"])
    if f.type == "string":
        return len(o["values"]) if o.get("encode", "index") == "onehot" else 1
    if f.type == "vector":
        return sum(int(r[6:]) if r.startswith("vector") else 1 for r in o.get("reduce", ["min", "max", "size", "avg"]))
    if f.type == "interacted_with":
        return len(o["field"]) if isinstance(o.get("field"), list) else 1
    return 1


def load(config: dict) -> Plan:
    """Checks that names are unique and that models refer to features that are there."""
    features: dict[str, Feature] = {}
    for spec in config.get("features", []):
        f = feature(spec)
        if f.name in features:
            raise ConfigError(f"two features are named {f.name}")
        features[f.name] = f
    models = config.get("models", {})
    for name, model in models.items():
        for used in model.get("features", []):
            if used not in features:
                raise ConfigError(f"model {name} uses {used}, which is no feature")
    return Plan(features, models)
