"""Words and phrases by which texts are told apart."""

# Phrases of each topic.
TOPIC_CUES = {
    "Production": ["production", "produced", "output", "tonnage", "production performance"],
    "Exploration": ["exploration", "prospecting", "drilling programme", "drilling program", "reserve estimation"],
    "Geology": ["geology", "geological", "lithology", "strata", "seam", "ore body", "orebody"],
    "Mining Operations": ["mining operations", "opencast", "open cast", "underground", "excavation", "blasting", "haulage"],
    "Overburden": ["overburden", "ob removal", "over burden", "stripping"],
    "Coal and Lignite": ["lignite", "coal production", "coal mine", "coking coal", "thermal coal"],
    "Safety": ["safety", "accident", "incident", "fatality", "mine safety", "occupational health"],
    "Environment": ["environment", "environmental", "emission", "afforestation", "water quality", "air quality", "pollution"],
    "Infrastructure": ["infrastructure", "conveyor", "railway siding", "power plant", "washery", "workshop"],
    "Equipment": ["equipment", "excavator", "dumpers", "shovel", "dragline", "machinery"],
    "Rehabilitation": ["rehabilitation", "reclamation", "backfilling", "mine closure", "land restoration"],
    "Financial and Operational Performance": ["financial", "revenue", "profit", "operational performance", "turnover", "ebitda"],
    "Targets and Achievements": ["target", "achievement", "against the target", "capacity utilisation", "capacity utilization"],
}
# Phrases of each domain with their weights.
DOMAIN_CUES = {
    "geological_exploration": {
        "borehole": 3.0, "bore hole": 3.0, "drilling": 2.5, "drill hole": 2.5, "coal seam": 3.0, "seam thickness": 3.0, "seam depth": 3.0, "lithology": 3.0, "sandstone": 2.0, "shale": 2.0, "geological formation": 3.0, "formation": 1.5,
        "fault": 2.0, "exploration": 2.0, "geological section": 2.5, "stratigraphy": 3.0, "coal quality": 2.5, "resource": 1.2, "reserve": 1.2, "core log": 2.5, "lithological": 2.5, "overburden rock": 1.5, "geological report": 2.5, "seam ": 1.8,
    },
    "mining_production": {
        "production": 2.5, "offtake": 2.5, "dispatch": 2.0, "overburden removal": 2.0, "achievement": 2.0, "target": 1.5, "mt": 1.0, "million tonnes": 2.0, "coal production": 3.0, "monthly return": 2.0, "subsidiary": 1.2, "oc production": 2.0, "ug production": 2.0,
    },
    "environmental": {"environmental": 3.0, "emission": 2.5, "afforestation": 2.5, "reclamation": 2.0, "water quality": 2.5, "air quality": 2.5, "effluent": 2.5, "cpm": 1.5, "green belt": 2.0, "pollution": 2.5, "compliance": 1.5},
    "project_technical": {"feasibility": 2.5, "dpr": 2.0, "detailed project report": 3.0, "technical specification": 2.5, "engineering design": 2.5, "project report": 2.0, "tender": 1.5, "scope of work": 2.0, "bill of quantities": 2.0},
}
