"""Tables of contents: the linked outline items, and the pages that their destinations name."""

from __future__ import annotations

from dataclasses import dataclass, field

from leafspark.kernels.objects import BLANK, Name, Ref, name, text_string


@dataclass
class Item:
    title: str
    page: int | None
    children: list[Item] = field(default_factory=list)


class Outline:
    def __init__(self, document):
        self.document = document
        self.pages = document.pages()
        self.index = {p.ref: i for i, p in enumerate(self.pages) if p.ref is not None}
        root = document.deref(document.trailer.get("Root"))
        self.root = root if isinstance(root, dict) else {}
        self._named: dict[str, object] | None = None

    def items(self) -> list[Item]:
        """The tree; an item met twice ends its chain, one without a title goes with all below it."""
        top = self.document.deref(self.root.get("Outlines"))
        out: list[Item] = []
        if not isinstance(top, dict):
            return out
        seen: set[Ref] = set()
        # A chain waits while the items below one of its own are walked, which come first.
        chains: list[tuple[object, list[Item]]] = [(top.get("First"), out)]
        while chains:
            value, into = chains.pop()
            if isinstance(value, Ref):
                if value in seen:
                    continue
                seen.add(value)
            node = self.document.deref(value)
            if not isinstance(node, dict):
                continue
            if "Next" in node:
                chains.append((node["Next"], into))
            title = (text_string(self.document.deref(node.get("Title"))) or "").strip(BLANK)
            if not title:
                continue
            item = Item(title, self._page_of(node))
            into.append(item)
            if "First" in node:
                chains.append((node["First"], item.children))
        return out

    def _page_of(self, node: dict) -> int | None:
        if "Dest" in node:
            return self.destination(node["Dest"], set())
        action = self.document.deref(node.get("A"))
        if not isinstance(action, dict):
            return None
        kind = self.document.deref(action.get("S"))
        if kind is None or name(kind) == "GoTo":
            return self.destination(action.get("D"), set())
        if name(kind) == "Named":
            which = name(self.document.deref(action.get("N")))
            return self.clamp(0) if which == "FirstPage" else self.clamp(len(self.pages) - 1) if which == "LastPage" else None
        return None

    def destination(self, value, names: set[str]) -> int | None:
        """The page index of a destination: direct, in a dictionary, or by name."""
        value = self.document.deref(value)
        if isinstance(value, dict):
            return self.destination(value["D"], names) if "D" in value else None
        key = self.key(value)
        if key is not None:
            if key in names:
                return None
            names.add(key)
            return self.destination(self.named().get(key), names)
        if isinstance(value, list) and value:
            first = value[0]
            if isinstance(first, Ref):
                return self.index.get(first)
            return self.clamp(first) if type(first) is int else None
        return None

    def clamp(self, index: int) -> int | None:
        return None if not self.pages or index < 0 else min(index, len(self.pages) - 1)

    @staticmethod
    def key(value) -> str | None:
        return str(value) if isinstance(value, Name) else text_string(value)

    def named(self) -> dict[str, object]:
        """Destinations by name: the old dictionary first, then the name tree in order; the first of a name counts."""
        if self._named is None:
            self._named = {}
            old = self.document.deref(self.root.get("Dests"))
            for k, v in old.items() if isinstance(old, dict) else ():
                self._named.setdefault(k, v)
            for k, v in self._tree():
                self._named.setdefault(k, v)
        return self._named

    def _tree(self):
        trees = self.document.deref(self.root.get("Names"))
        stack: list[object] = [trees.get("Dests")] if isinstance(trees, dict) else []
        seen: set[Ref] = set()
        while stack:
            value = stack.pop()
            if isinstance(value, Ref):
                if value in seen:
                    continue
                seen.add(value)
            node = self.document.deref(value)
            if not isinstance(node, dict):
                continue
            pairs = self.document.deref(node.get("Names"))
            if isinstance(pairs, list):
                for k, v in zip(pairs[::2], pairs[1::2]):
                    key = self.key(self.document.deref(k))
                    if key is not None:
                        yield key, v
            kids = self.document.deref(node.get("Kids"))
            if isinstance(kids, list):
                stack += reversed(kids)


def rows(items: list[Item]) -> list[tuple[int, int | None, int, list[int], str, int | None]]:
    """(entry, parent, depth, path, title, page) of a tree, in reading order."""
    out: list = []
    stack = [(item, None, [k]) for k, item in reversed(list(enumerate(items)))]
    while stack:
        item, parent, path = stack.pop()
        entry = len(out)
        out.append((entry, parent, len(path), path, item.title, item.page))
        stack += [(child, entry, [*path, k]) for k, child in reversed(list(enumerate(item.children)))]
    return out
