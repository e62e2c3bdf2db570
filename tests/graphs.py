"""A small invented graph for tests: boats, their builders and the races they sail."""

TURTLE = """
@prefix o: <http://sea.example/onto#> . @prefix d: <http://sea.example/id/> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
d:gull a o:Sloop ; rdfs:label "Gull"@en, "Mouette"@fr ; o:builtBy d:north ; o:length 9.5 ; o:hullCode "G-1" ; o:launched "2019-05-01"^^xsd:date .
d:tern a o:Sloop ; rdfs:label "Tern" ; o:builtBy d:north ; o:length 12 ; o:hullCode "T-2" ; o:launched "2021-07-15"^^xsd:date .
d:orca a o:Ketch ; rdfs:label "Orca" ; o:builtBy d:south ; o:length 12.0 ; o:hullCode "O-3" ; o:launched "not a date"^^xsd:date .
d:north a o:Yard ; rdfs:label "North Yard" ; o:town "Skerry" . d:south a o:Yard ; rdfs:label "South Yard" ; o:town "Holm" ; o:parent d:north .
"""
RACES = """
@prefix o: <http://sea.example/onto#> . @prefix d: <http://sea.example/id/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
d:r1 a o:Start ; o:boatCode "G-1" ; o:place 1 ; o:prize "100.50"^^xsd:decimal . d:r2 a o:Start ; o:boatCode "G-1" ; o:place 3 ; o:prize "100.50"^^xsd:decimal .
d:r3 a o:Start ; o:boatCode "O-3" ; o:place 2 ; o:prize "70"^^xsd:decimal .
"""
ONTOLOGY = """
@prefix o: <http://sea.example/onto#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
o:Boat a owl:Class ; rdfs:label "boat" ; skos:altLabel "vessel" . o:Sloop a owl:Class ; rdfs:label "sloop" ; rdfs:subClassOf o:Boat . o:Ketch a owl:Class ; rdfs:label "ketch" ; rdfs:subClassOf o:Boat .
o:Yard a owl:Class ; rdfs:label "yard" . o:Start a owl:Class ; rdfs:label "start" . o:Ghost a owl:Class ; rdfs:label "ghost" .
o:builtBy a owl:ObjectProperty ; rdfs:label "built by" ; rdfs:domain o:Boat ; rdfs:range o:Yard .
o:hullCode a owl:DatatypeProperty ; rdfs:label "hull code" ; rdfs:domain o:Boat ; o:identifierScheme "hull" .
o:boatCode a owl:DatatypeProperty ; rdfs:label "boat code" ; rdfs:domain o:Start ; o:identifierScheme "hull" .
o:length a owl:DatatypeProperty ; rdfs:label "length" ; skos:altLabel "long" ; rdfs:domain o:Boat .
"""
SHAPES = """
@prefix o: <http://sea.example/onto#> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
o:S a sh:NodeShape ; sh:targetClass o:Boat ; sh:property [ sh:path o:length ; sh:datatype xsd:decimal ; sh:minCount 1 ; sh:maxCount 1 ] .
"""
FLEET, RACING = "http://sea.example/graph/fleet", "http://sea.example/graph/racing"
O, D = "http://sea.example/onto#", "http://sea.example/id/"
PREFIXES = {"o": O, "d": D, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#", "g": "http://sea.example/graph/"}


def quads(spark):
    from triplane.sources.quads import distinct_quads, quads_from_text, typed

    return typed(distinct_quads(quads_from_text(spark, TURTLE, FLEET).unionByName(quads_from_text(spark, RACES, RACING))))
