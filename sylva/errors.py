"""Conditions that callers can tell apart."""

from __future__ import annotations


class XmlError(ValueError):
    """Base of the errors below."""


class XmlParseError(XmlError):
    """A source isn't well-formed XML."""

    def __init__(self, message: str, source: str | None = None):
        super().__init__(message)
        self.source = source


class XmlCallbackError(XmlError):
    """A caller's callback failed; the cause is its own exception."""


class XmlNodesError(XmlError):
    """A node table breaks the canonical contract."""


class XmlStructureError(XmlError):
    """A path or value selection can't be resolved against a document's structure."""


class XmlProfileError(XmlError):
    """A profile or specification isn't valid."""


class XmlTypeError(XmlError):
    """A value doesn't fit its declared type."""

    def __init__(self, source: str, output_name: str, declared_type: str, value: str | None):
        super().__init__(f"Source '{source}' (output '{output_name}') has a value that is not {declared_type}: {value!r}")
        self.source, self.output_name, self.declared_type, self.value = source, output_name, declared_type, value


class XmlProposalError(XmlError):
    """Evidence for a proposal can't be used."""
