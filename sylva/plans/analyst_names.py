"""Names in analyst tables: namespace aliases, tokens, entity aliases, key scores. Driver-side, on dictionaries of names."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from ..functions.naming import local_of, make_unique, uri_of

MISC = "xml_misc"


def clean_token(text: str, fallback: str = "value") -> str:
    """Letters, digits and single underscores; never empty, never with a digit first."""
    out = re.sub(r"_+", "_", re.sub(r"[^\w]+", "_", text.replace(":", "_"))).strip("_") or fallback
    return f"x_{out}" if out[0].isdigit() else out


@dataclass
class Namespaces:
    """What each URI is called."""

    default: str | None = None
    alias: dict[str, str] = field(default_factory=dict)
    fallback: dict[str, str] = field(default_factory=dict)
    collisions: set[str] = field(default_factory=set)

    @property
    def description(self) -> str | None:
        return "; ".join(f"{a or '(default)'}={u}" for u, a in self.alias.items()) or None

    def element(self, name: str) -> str:
        """The token of an expanded element name."""
        local, uri = local_of(name), uri_of(name)
        if not uri:
            return clean_token(local)
        if uri == self.default:
            alias = self.fallback[uri] if local in self.collisions else ""
        else:
            alias = self.alias[uri]
        return f"{alias}_{clean_token(local)}" if alias else clean_token(local)

    def attribute(self, name: str) -> str:
        local, uri = local_of(name), uri_of(name)
        return f"{self.alias[uri] or self.fallback[uri]}_{clean_token(local)}" if uri else clean_token(local)


def namespaces(names: list) -> Namespaces:
    """From rows with node_type, namespace_uri, prefix, local_name in first-seen order; the first element is the root."""
    out = Namespaces()
    elements = [r for r in names if r.node_type == "element"]
    if elements and elements[0].namespace_uri and not elements[0].prefix:
        out.default = elements[0].namespace_uri
    prefixes: dict[str, list[str]] = {}
    for r in names:
        if r.namespace_uri:
            found = prefixes.setdefault(r.namespace_uri, [])
            if r.prefix and not re.fullmatch(r"ns[0-9]+", token := clean_token(r.prefix, "ns")):
                found.append(token)
    used: set[str] = set()
    for uri, found in prefixes.items():
        out.alias[uri] = ""
        if found and uri != out.default:
            alias, n = found[0], 1
            while alias in used:
                n += 1
                alias = f"{found[0]}_{n}"
            out.alias[uri] = out.fallback[uri] = alias
            used.add(alias)
    n = 0
    for uri in prefixes:
        if uri not in out.fallback:
            n += 1
            while f"ns{n}" in used:
                n += 1
            out.fallback[uri] = f"ns{n}"
            used.add(f"ns{n}")
        if uri != out.default:
            out.alias[uri] = out.fallback[uri]
    out.alias = {uri: out.alias[uri] for uri in prefixes}
    if out.default is not None:
        out.collisions = {r.local_name for r in elements if r.namespace_uri == out.default} & {r.local_name for r in elements if not r.namespace_uri}
    return out


def entity_aliases(paths: list[list[str]]) -> list[str]:
    """The shortest suffixes of token paths that tell them apart."""
    widths = [1] * len(paths)
    while True:
        out = ["__".join(p[-w:]) for p, w in zip(paths, widths, strict=True)]
        counts = Counter(out)
        wider = [i for i, a in enumerate(out) if counts[a] > 1 and widths[i] < len(paths[i])]
        if not wider:
            return [f"xml_source{a[3:]}" if a == MISC else a for a in make_unique(out, "__ns")]
        for i in wider:
            widths[i] += 1


# Names that identify what they stand in, and columns whose types are never guessed.
IDENTIFIERS = ("id", "identifier", "uuid", "guid", "accession", "recordreference", "about")
UNTYPED = re.compile(r"(^|_)(id|identifier|accession|code|key|ref)$", re.IGNORECASE)


def is_untyped(column: str) -> bool:
    last = column.rpartition("__")[2].removeprefix("attr_")
    return bool(UNTYPED.search(last)) or column.startswith(f"{MISC}__") or column.endswith("__text_content")


def _compact(token: str) -> str:
    return re.sub(r"[^a-z0-9]", "", token.removeprefix("attr_").lower())


def _exact(token: str) -> bool:
    """Whether a token's last part is an identifier's name; what stands before an underscore, as a namespace's alias, isn't looked at."""
    return _compact(token.removeprefix("attr_").rpartition("_")[2]) in IDENTIFIERS


def key_score(entity: str, column: str) -> int:
    """How well a column suits as the source key of an entity; 99: not at all."""
    if not column.startswith(f"{entity}__"):
        return 99
    parts = column[len(entity) + 2 :].split("__")
    last = parts[-1]
    if len(parts) == 1:
        if _exact(last):
            return 1
        compact = _compact(last)
        stem = compact[:-2] if compact.endswith("id") else ""
        return 3 if stem and stem == _compact(entity.rpartition("__")[2]) else 99
    if len(parts) == 2 and last.startswith("attr_"):
        if _compact(last) == "value" and _exact(parts[0]):
            return 2
        if _compact(last) == "addr":
            return 4
    return 99
