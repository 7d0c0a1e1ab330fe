"""How the attributes of a census section's profile are compared."""

from .similarity_groups import Feature

_TIME = {"least": 0.01, "factors": (60.0,)}
#: The twelve profile values: counts may differ by a few units, times may stand in seconds, heights in other units.
SECTION_FEATURES = (
    Feature("popolazione_rif", units=3, least=1),
    Feature("famiglie_rif", units=3, least=1),
    Feature("abitazioni_rif", units=3, least=1),
    Feature("dislivello_sezione_m", units=0.5, factors=(100.0, 1000.0)),
    Feature("servizi_5_min", units=3),
    Feature("servizi_15_min", units=3),
    Feature("tempo_associazioni_min", **_TIME),
    Feature("tempo_cultura_min", **_TIME),
    Feature("tempo_ristorazione_min", **_TIME),
    Feature("tempo_attivita_economiche_min", **_TIME),
    Feature("tempo_fermata_min", **_TIME),
    Feature("passaggi_totali", units=3),
)
