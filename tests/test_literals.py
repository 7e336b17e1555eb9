import pytest

from fieldspan.operators import embedded, images, literals


@pytest.mark.parametrize(
    "text, value",
    [
        ('{"a": 1}', {"a": 1}),
        ("{a: 'x', \"b\": [1, , .5, 0x10,], c: !0, d: void 0, e: undefined, /* c */ f: `t`}", {"a": "x", "b": [1, None, 0.5, 16], "c": True, "d": None, "e": None, "f": "t"}),
        (r"'a\né\x41\u{1F600}'", "a\né" + "A😀"),
        ("(function(a,b){return {x:a,y:[b,a]}}(1,\"z\"))", {"x": 1, "y": ["z", 1]}),
        ("{a: -1.5e3};", {"a": -1500.0}),
    ],
)
def test_literals(text, value):
    assert literals.read_literal(text) == value


@pytest.mark.parametrize("bad", ["{a: alert(1)}", "`${x}`", "{a: 1} x", "[" * 500, "'open", ""])
def test_not_literals(bad):
    with pytest.raises(ValueError):
        literals.read_literal(bad)


def test_unflatten():
    assert literals.unflatten([{"a": 1, "b": 2}, "x", [3, 3], 5]) == {"a": "x", "b": [5, 5]}
    assert literals.unflatten([["Reactive", 1], {"k": 2}, -1]) == {"k": -1}
    assert literals.unflatten([{"d": 1}, ["Date", "2024-01-01"]]) == {"d": "2024-01-01"}


def test_data_uri():
    assert literals.data_uri("data:image/png;base64,aGk=") == (b"hi", "image/png")
    assert literals.data_uri("data:,a%20b") == (b"a b", "text/plain")
    with pytest.raises(ValueError):
        literals.data_uri("http://x")


def test_state_of_pages():
    assert embedded.read_blobs("<script>window.__NUXT__={a:'x'};</script>") == [("app_state", "__NUXT__", '{"a": "x"}')]
    assert embedded.read_blobs('<script type="application/json">[{"a":1},"x"]</script>') == [("app_state", "", '{"a": "x"}')]


def test_image_text():
    pieces = [(0, 0, 100, 30, "Title"), (0, 40, 30, 50, "Power:"), (35, 41, 60, 51, "5 kW"), (0, 60, 50, 70, "one"), (0, 72, 50, 82, "two"), (0, 120, 50, 130, "three")]
    assert images.blocks(pieces) == [("heading", "Title"), ("paragraph", "Power: 5 kW"), ("paragraph", "one two"), ("paragraph", "three")]
    assert images.blocks([]) == []
