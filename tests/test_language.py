import pytest

from morphspark.errors import Diagnostics, DivisionByZero, ParseError, TypeMismatch, UnknownOperation, UnknownVariable
from morphspark.evaluate import Evaluator, Unique
from morphspark.lang import ast as A
from morphspark.lang.parser import parse_expression, parse_module
from morphspark.sources.ecore import parse_ecore
from morphspark.sources.resource import load_module, save_module
from morphspark.sources.xmi import expression_from_xmi, expression_to_xmi, module_from_xmi, module_to_xmi

CASES = [
    ("23 + 19", 42), ("12 * 11", 132), ("9 / 4", 2.25), ("'oak' = 'oak'", True), ("2 > 31", False), ("false or true", True), ("true xor false", True), ("true implies false", False),
    ("Sequence{4,9}->size()", 2), ("'quay'.size()", 4), ("Sequence{'fig','yew'}->includes('elm')", False), ("'Parcel no 7'.toUpperCase()", "PARCEL NO 7"),
    ("29.mod(6)", 5), ("13.isEven()", False), ("12.square()", 144), ("2.power(10)", 1024), ("-7 div 2", -3), ("0.5 + 1", 1.5), ("'drawer'.reverse()", "reward"), ("'abcdef'.substring(2, 4)", "bcd"),
    ("'a.b.c'.split('.')->size()", 3), ("'x+y+z'.replaceAll('+', '-')", "x-y-z"), ("(0.1 + 0.2).toString()", "0.30000000000000004"), ("(5.0 * 2000000).toString()", "1.0E7"), ("0.00025.toString()", "2.5E-4"), ("12.5.toString()", "12.5"),
    ("Sequence{1,2}->includesAll(Sequence{2})", True), ("Set{1,2} = Set{2,1}", True), ("Sequence{1,2} = Sequence{2,1}", False),
    ("Sequence{1,2,3,4,5,6}->select(n | n.mod(2) = 0)", [2, 4, 6]), ("Sequence{1,2,3}->reject(n | n > 2)", [1, 2]), ("Sequence{1,2}->collect(n | n * n)", [1, 4]), ("Sequence{1,2}->exists(n | n = 2)", True),
    ("Sequence{}->forAll(n | n = 2)", True), ("Sequence{1,2,2}->one(n | n = 2)", False), ("Sequence{3,1,2}->sortedBy(n | n)->first()", 1), ("Sequence{1,2,3}->any(n | n > 1)", 2), ("Set{1,1,2}->size()", 2),
    ("Sequence{1,2}->union(Sequence{2})", [1, 2, 2]), ("Set{1,2}->union(Set{2,3})", Unique([1, 2, 3])), ("Sequence{1,2,2}->intersection(Sequence{2})", [2, 2]), ("Sequence{Sequence{1},Sequence{2}}->flatten()", [1, 2]),
    ("Sequence{1,2,3}->subSequence(2,3)", [2, 3]), ("Sequence{5,6}->indexOf(6)", 2), ("Sequence{1,2,3}->iterate(x; a : Integer = 0 | a + x)", 6), ("let x : Integer = 3 in x + 1", 4), ("Tuple{a = 1}.a", 1),
    ("if 1 > 2 then 'a' else if 1 > 0 then 'b' else 'c' endif", "b"), ("OclUndefined.oclIsUndefined()", True), ("Map{('a', 1)}.get('a')", 1), ("OrderedSet{2,1,2}->last()", 1), ("3 <- 1", False), ("not true", False),
]


@pytest.mark.parametrize("text,value", CASES)
def test_evaluates(text, value):
    got = Evaluator().eval(parse_expression(text))
    assert got == value and type(got) is type(value)


@pytest.mark.parametrize("text,value", CASES)
def test_xmi_round_trip(text, value):
    e = parse_expression(text)
    assert expression_from_xmi(expression_to_xmi(e)) == e


@pytest.mark.parametrize("text,error", [("'s' + 5", TypeMismatch), ("10 / 0", DivisionByZero), ("5.nothing()", UnknownOperation), ("x", UnknownVariable), ("'a'.mod(2)", TypeMismatch), ("2.power(-1)", TypeMismatch)])
def test_errors(text, error):
    with pytest.raises(error):
        Evaluator().eval(parse_expression(text))


@pytest.mark.parametrize("text", ["1 +", "'open", "if 1 then 2", "Sequence{1", "a ? b", "module"])
def test_parse_errors(text):
    with pytest.raises(ParseError):
        parse_expression(text) if text != "module" else parse_module(text)


MODULE = """-- @path People=people.ecore
module M; create OUT : Persons from IN : People;
helper def : fact(n : Integer) : Integer = if n < 2 then 1 else n * fact(n - 1) endif;
helper context Integer def : twice() : Integer = self * 2;
helper context People!Member def : full : String = self.first + ' X';
query q = fact(5);
rule A { from s : People!Member (s.first <> 'Z') using { k : Integer = 1; } to t : Persons!Male (name <- s.full), u : Persons!Tag (of <- t) do { t.extra <- 'e'; } }
lazy rule L { from s : People!Member to t : Persons!Tag (of <- s.first) }
rule C(p : String, n : Integer) { to t : Persons!Tag (of <- p) }
"""


def test_module_and_xmi(tmp_path):
    m = parse_module(MODULE)
    assert [r.kind for r in m.rules] == ["matched", "lazy", "called"] and m.paths == (("People", "people.ecore"),)
    assert m.rules[0].targets[0].bindings[-1] == A.Binding("extra", A.Lit("e", "String"))
    assert module_from_xmi(module_to_xmi(m)) == m
    save_module(m, tmp_path / "m.xmi")
    assert load_module(tmp_path / "m.xmi")[0] == m
    ev = Evaluator(m)
    assert ev.eval(parse_expression("fact(5) + 4.twice()")) == 128


def test_ecore():
    mm = parse_ecore("""<ecore:EPackage xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:ecore="http://www.eclipse.org/emf/2002/Ecore" name="People" nsURI="http://p" nsPrefix="p">
      <eClassifiers xsi:type="ecore:EClass" name="Base"><eStructuralFeatures xsi:type="ecore:EAttribute" name="id" eType="ecore:EDataType http://www.eclipse.org/emf/2002/Ecore#//EString" iD="true"/></eClassifiers>
      <eClassifiers xsi:type="ecore:EClass" name="Member" eSuperTypes="#//Base"><eStructuralFeatures xsi:type="ecore:EReference" name="father" eType="#//Member"/></eClassifiers></ecore:EPackage>""")
    assert mm.key("Member") == "id" and mm.lineage("Member") == ["Member", "Base"] and not mm.feature("Member", "father").many


def test_parsing_goes_on_after_errors():
    errors = []
    m = parse_module("module M; query a = ; query b = 2; rule R { to } helper def : c : Integer = 3;", errors)
    assert [q.name for q in m.queries] == ["b"] and [h.name for h in m.helpers] == ["c"] and len(errors) == 2 and all(isinstance(e, ParseError) for e in errors)
    with pytest.raises(ParseError):
        parse_module("module M; query a = ;")


def test_diagnostics():
    d, other = Diagnostics(), Diagnostics()
    d.event("begun")
    d.warning("no semicolon")
    d.error("no model")
    other.errors, other.warnings = ["no model"], ["no semicolon"]
    assert d == other and [x[1] for x in d.timeline] == ["event", "warning", "error"]
    assert d.summary() == "1 errors\n  no model\n1 warnings\n  no semicolon"
    d.clear()
    assert not d.errors and not d.timeline and d.summary() == ""
