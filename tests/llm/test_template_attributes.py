"""Only attribute names tell that an element is dropped, not what stands in other attributes' values."""

import pytest

from dosewise.llm import template


@pytest.mark.parametrize("attributes,kept", [
    ('style="overflow: hidden"', True), ("style='visibility: x; overflow: hidden' id=a", True), ('title="The hidden cost"', True),
    ('data-x="a hidden thing"', True), ('data-note="see class=menu role=search"', True), ("hidden-by=none data-hidden", True), ('"a hidden quote" lang=en', True),
    ("style=overflow:hidden", True), ('title="x" hidden', False), ("HIDDEN", False), ('hidden="" title=x', False), ("aria-hidden = 'true'", False),
    ('title="a > b" class="x menu"', False), ("class=menu/", False), ('style="a"class="menu"', False), ("role=search hidden=until-found", False),
])
def test_attributes(attributes, kept):
    for tag in ("div", "body", "article"):
        if tag == "div" or "menu" not in attributes and "search" not in attributes:
            assert template.Page(f"<{tag} {attributes}><p>Text</p></{tag}><p>And more text</p>").text(set()).startswith("Text") == kept, tag
