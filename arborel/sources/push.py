"""Push parsing: events as chunks of a document arrive, without a tree and without holding the document."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

from .xml import XmlSyntaxError

#: (event, name, value, attributes, line, column)
Event = tuple[str, str, str | None, dict[str, str], int, int]


class PushParser:
    """Takes a document of XML chunk by chunk and gives the events of what is complete.

    ``write`` returns the events that a chunk completes, ``finish`` the rest.
    Text is given as it comes, so one run of text may be several events.
    Input that isn't well-formed raises :class:`XmlSyntaxError`, unless it is to
    ``recover``: then an error event ends the document and what follows is left.
    """

    def __init__(self, encoding: str | None = None, recover: bool = True):
        self.recover, self.done = recover, False
        self.events: list[Event] = []
        self.cdata = False
        p = self.parser = expat.ParserCreate(encoding)
        p.ordered_attributes = False
        p.XmlDeclHandler = lambda version, enc, standalone: self._add("xmldecl", "", version, {k: v for k, v in (("encoding", enc), ("standalone", {0: "no", 1: "yes"}.get(standalone))) if v})
        p.StartElementHandler = lambda name, attrs: self._add("start_element", name, None, dict(attrs))
        p.EndElementHandler = lambda name: self._add("end_element", name)
        p.CharacterDataHandler = lambda text: self._add("cdata_block" if self.cdata else "characters", "", text)
        p.CommentHandler = lambda text: self._add("comment", "", text)
        p.ProcessingInstructionHandler = lambda target, text: self._add("processing_instruction", target, text)
        p.StartCdataSectionHandler = lambda: setattr(self, "cdata", True)
        p.EndCdataSectionHandler = lambda: setattr(self, "cdata", False)
        self._add("start_document")

    def _add(self, event: str, name: str = "", value: str | None = None, attrs: dict[str, str] | None = None) -> None:
        p = self.parser
        self.events.append((event, name, value, attrs or {}, p.CurrentLineNumber, p.CurrentColumnNumber))

    def _taken(self) -> list[Event]:
        out, self.events = self.events, []
        return out

    def _parse(self, chunk: str | bytes, last: bool) -> list[Event]:
        if self.done:
            return self._taken()
        try:
            self.parser.Parse(chunk, last)
        except expat.ExpatError as e:
            self.done = True
            message = expat.errors.messages.get(e.code, str(e))
            if not self.recover:
                raise XmlSyntaxError(message, e.lineno) from None
            self.events.append(("error", "", message, {}, e.lineno, e.offset))
            self._add("end_document")
        if last and not self.done:
            self.done = True
            self._add("end_document")
        return self._taken()

    def write(self, chunk: str | bytes) -> list[Event]:
        return self._parse(chunk, False)

    def finish(self) -> list[Event]:
        return self._parse(b"", True)


def push(chunks: Iterator[str | bytes], **options) -> Iterator[Event]:
    """Events of a document whose chunks come one after another."""
    parser = PushParser(**options)
    for chunk in chunks:
        yield from parser.write(chunk)
    yield from parser.finish()
