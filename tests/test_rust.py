import pytest

from orrery.sources import rust

SOURCE = '''use std::fmt::Display;

pub struct Greeter;

impl Greeter {
    /// says if ready
    pub fn greet(&self, ready: bool) -> bool {
        if ready && self.ok() { return true; } // if || while
        false
    }
}

fn choose(x: u8) -> &'static str {
    match x {
        0 => "if { zero",
        _ => "more",
    }
}
'''


def test_symbols(spark):
    df = spark.createDataFrame([("src/lib.rs", SOURCE), ("src/a/mod.rs", ""), ("src/n.rs", None)], "path string, content string")
    got = {r["name"]: r for r in rust.rust_symbols(df).collect()}
    assert {k: (r["kind"], r["parameters"], r["complexity"]) for k, r in got.items()} == {"Greeter": ("type", 0, 0), "greet": ("method", 2, 3), "choose": ("function", 1, 3)}
    greet = got["greet"]
    assert greet["qualified_name"] == "Greeter::greet" and (greet["line_start"], greet["line_end"], greet["lines_of_code"]) == (7, 10, 4)
    assert greet["signature"] == "pub fn greet(&self, ready: bool) -> bool"
    imports = rust.rust_imports(df).collect()
    assert [r["target"] for r in imports] == ["std::fmt::Display"] and imports[0]["id"].startswith("module_")


def test_module_parts():
    assert rust.module_parts("src/a/b.rs") == ["a", "b"] and rust.module_parts("src/lib.rs") == [] and rust.module_parts("x/mod.rs") == ["x"]


@pytest.mark.parametrize(
    "code, n",
    [
        ("a && b", 1), ("a && b && c", 2), ("a || b && c", 2), ("(a && b) == c", 2), ("q + p + (a && b)", 2), ("p + (a && b) + q", 3), ("x == y && z", 1), ("foo(a && b) == c", 2),
        ("!(a && b)", 1), ("|| a && b", 1), ("v.any(|x| x && y)", 1), ("a == b", 0), ("let x = a && b; c || d", 2), ("f(|a, b| a || b) + 1", 2), ("m[i && j] < 3", 2), ("*a && &b", 1), ("x as u8 == 1 && y", 1), ("", 0),
    ],
)
def test_logical_expressions(code, n):
    """Each binary expression that holds a logical operator counts."""
    assert rust.logical_expressions(rust.tokens(code)) == n


def test_balanced():
    assert rust.balanced('fn a() { ("}") }') and not rust.balanced("fn a( }") and not rust.balanced("fn a() {")
