"""Small documents that the tests share. Each is made for the rules that its name says."""

#: Records with nested, repeated and missing elements, in a default namespace, with a leading zero.
VOYAGES = """<?xml version="1.0"?>
<logbook xmlns="urn:sylva:logbook" keeper="Mate">
  <voyage no="V17">
    <leg dist="31"><from>Oban</from><to>Tiree</to><tide rising="yes">3.1</tide></leg>
    <leg dist="14"><from>Tiree</from><to>Coll &amp; back</to></leg>
    <leg dist="9"><from>Coll</from><to>Tobermory</to></leg>
    <vessel><callsign>07QX</callsign><tonnage>512</tonnage></vessel>
    <phase>under way</phase>
  </voyage>
  <voyage no="V18">
    <vessel><callsign>0044</callsign></vessel>
    <phase>moored</phase>
  </voyage>
  <voyage no="V19">
    <leg dist="70"><from>Mallaig</from><to>Barra</to></leg>
    <vessel><callsign>9LM</callsign><tonnage>88</tonnage></vessel>
    <phase>moored</phase>
  </voyage>
</logbook>"""

#: Records of scalars only.
CREW = '<crew><hand badge="h1"><rank>mate</rank><since>2011-05-02</since></hand><hand badge="h2"><rank>cook</rank><since>1998-12-31</since></hand><hand badge="h3"><rank>mate</rank><since>2020-02-29</since></hand></crew>'

#: Repetitions that have nothing to do with each other.
HARVEST = '<farm><plot code="N4"><frost day="12"/><sown><seed kg="40">rye</seed><seed kg="25">oat</seed><seed kg="8">flax</seed></sown><frost day="13"/></plot></farm>'

MIXED = '<notice><line>Mind <b weight="2">the</b> gap &amp; the step.</line><![CDATA[x > y]]><!--draft--><?print twice?></notice>'

#: The same local name in three namespaces.
CARDS = '<deck xmlns="urn:sylva:plain" xmlns:r="urn:sylva:red" xmlns:k="urn:sylva:black"><k:card r:worn="no">seven</k:card><card>joker</card><r:card k:marked="no" r:worn="yes">ace</r:card></deck>'

MISC = "<?style plain?><?style bold?><!--top--><sheet><cell>9</cell></sheet><!--foot-->"

#: A column of each type, and digits that aren't a number.
GAUGES = '<gauges><gauge tag="g1"><hits>41</hits><level>0.75</level><open>false</open><checked>2024-02-29</checked><plate>01070</plate></gauge><gauge tag="g2"><hits>-3</hits><level>6</level><open>true</open><checked>2023-07-01</checked><plate>00815</plate></gauge><gauge tag="g3"><hits>0</hits><level>1e1</level><open>true</open><checked>2023-07-01</checked><plate>10007</plate></gauge></gauges>'

#: Two kinds of records, neither the obvious one.
ARCHIVE = '<archive><shelf><map sheet="3"><scale>50</scale></map><map sheet="4"><scale>25</scale></map><map sheet="5"><scale>25</scale></map></shelf><box><letter from="A"><year>1890</year></letter><letter from="B"><year>1891</year></letter></box></archive>'

#: For analyst tables: nested entities, an empty attribute, an empty element, mixed text, comments.
MUSEUM = '<museum season="spring"><!--closed on Mondays--><wing floor="2" label=""><exhibit tag="E7"><caption>Amber <i>bee</i> in resin</caption><year>1890</year><loaned/></exhibit><exhibit tag="E8"><year>1921</year></exhibit><exhibit tag="E9"><year>1704</year></exhibit></wing><guard shift="late"><radio>5</radio></guard><guard shift="early"><radio>6</radio></guard></museum>'

GAUGES_XSD = """<s:schema xmlns:s="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:sylva:gauges">
<s:element name="gauges"><s:complexType><s:sequence><s:element name="gauge" minOccurs="0" maxOccurs="99"><s:complexType>
<s:all><s:element name="hits" type="s:short"/><s:element name="level" type="s:float"/><s:element name="open" type="s:boolean" minOccurs="0"/>
<s:element name="checked" type="s:date"/><s:element name="plate"><s:simpleType><s:restriction base="s:token"/></s:simpleType></s:element>
<s:element name="maker" type="makerName"/></s:all>
<s:attribute name="tag" type="s:NMTOKEN" use="required"/><s:attribute name="note" type="s:string"/>
</s:complexType></s:element></s:sequence></s:complexType></s:element>
<s:simpleType name="makerName"><s:restriction base="s:normalizedString"/></s:simpleType>
</s:schema>"""
