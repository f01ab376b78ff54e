"""Names and types of the register tables.

Column names are the public register's own, in snake case, so files and tables
already keyed by them can be read without renaming.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

ORG = "organisasjonsnummer"

# The column headers of the register's bulk company file, in file order.
COMPANY_HEADERS = """
organisasjonsnummer navn organisasjonsform.kode organisasjonsform.beskrivelse
naeringskode1.kode naeringskode1.beskrivelse naeringskode2.kode naeringskode2.beskrivelse
naeringskode3.kode naeringskode3.beskrivelse hjelpeenhetskode.kode hjelpeenhetskode.beskrivelse
harRegistrertAntallAnsatte antallAnsatte registreringsdatoAntallAnsatteEnhetsregisteret
registreringsdatoantallansatteNAVAaregisteret hjemmeside epostadresse telefon mobil
postadresse.adresse postadresse.poststed postadresse.postnummer postadresse.kommune
postadresse.kommunenummer postadresse.land postadresse.landkode
forretningsadresse.adresse forretningsadresse.poststed forretningsadresse.postnummer
forretningsadresse.kommune forretningsadresse.kommunenummer forretningsadresse.land
forretningsadresse.landkode institusjonellSektorkode.kode institusjonellSektorkode.beskrivelse
sisteInnsendteAarsregnskap registreringsdatoenhetsregisteret stiftelsesdato
registrertIMvaRegisteret registreringsdatoMerverdiavgiftsregisteret
registreringsdatoMerverdiavgiftsregisteretEnhetsregisteret frivilligMvaRegistrertBeskrivelser
registreringsdatoFrivilligMerverdiavgiftsregisteret registrertIFrivillighetsregisteret
registreringsdatoFrivillighetsregisteret registrertIForetaksregisteret
registreringsdatoForetaksregisteret registrertIStiftelsesregisteret registrertIPartiregisteret
registreringsdatoPartiregisteret konkurs konkursdato underAvvikling underAvviklingDato
underTvangsavviklingEllerTvangsopplosning tvangsopplostPgaManglendeDagligLederDato
tvangsopplostPgaManglendeRevisorDato tvangsopplostPgaManglendeRegnskapDato
tvangsopplostPgaMangelfulltStyreDato tvangsavvikletPgaManglendeSlettingDato overordnetEnhet
maalform vedtektsdato vedtektsfestetFormaal aktivitet paategninger
underUtenlandskInsolvensbehandlingDato underRekonstruksjonsforhandlingDato fravalgRevisjonDato
fravalgRevisjonBeslutningsDato erIKonsern kapital.belop kapital.antallAksjer kapital.type
kapital.bundet kapital.valuta kapital.innbetalt kapital.fulltInnbetalt kapital.innfortDato
registreringsnummerIHjemlandet utenlandskRegisterNavn utenlandskRegisterAdresse.land
utenlandskRegisterAdresse.poststed utenlandskRegisterAdresse.adresse underlagtLovgivningLand
underlagtLovgivningLandKode foretaksformIHjemlandet.kode foretaksformIHjemlandet.beskrivelse
foretaksformIHjemlandet.beskrivelseBokmaal
""".split()

# Headers whose column name does not follow from the header.
_RENAMED = {
    "registreringsdatoantallansatteNAVAaregisteret": "registreringsdato_antall_ansatte_nav_aaregisteret",
    "registreringsdatoenhetsregisteret": "registreringsdato_enhetsregisteret",
    "underTvangsavviklingEllerTvangsopplosning": "under_tvangsavvikling",
    "underlagtLovgivningLandKode": "underlagt_lovgivning_landkode",
}

# Columns that are neither text nor a date.
_TYPED = {
    "antallAnsatte": "int",
    "sisteInnsendteAarsregnskap": "smallint",
    "kapital.antallAksjer": "bigint",
    "kapital.belop": "numeric",
    "kapital.bundet": "numeric",
    "kapital.innbetalt": "numeric",
    "kapital.fulltInnbetalt": "bool",
    "harRegistrertAntallAnsatte": "flag",
    "konkurs": "flag",
    "underAvvikling": "flag",
    "underTvangsavviklingEllerTvangsopplosning": "flag",
    "paategninger": "flag",
    "erIKonsern": "flag",
}


def column_name(header: str) -> str:
    """Snake-case column name for a source header."""
    if header in _RENAMED:
        return _RENAMED[header]
    name = header.replace("Merverdiavgiftsregisteret", "MvaRegisteret").replace("Pga", "")
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name.replace(".", "_"))
    return name.lower()


def column_kind(header: str) -> str:
    """Target type of a source column: ``flag`` is a boolean where missing means false."""
    if header in _TYPED:
        return _TYPED[header]
    if re.match(r"registrertI[A-Z]", header):
        return "flag"
    return "date" if "dato" in header.lower() else "text"


#: (source header, column, kind) for every column of the company file.
COMPANY_MAPPING = [(h, column_name(h), column_kind(h)) for h in COMPANY_HEADERS]

SPARK_TYPES = {
    "text": T.StringType(),
    "date": T.DateType(),
    "int": T.IntegerType(),
    "smallint": T.ShortType(),
    "bigint": T.LongType(),
    "numeric": T.DecimalType(20, 2),
    "bool": T.BooleanType(),
    "flag": T.BooleanType(),
}

# The amount columns of an annual account.
AMOUNTS = """
sum_driftsinntekter sum_driftskostnad driftsresultat sum_finansinntekter sum_finanskostnad
netto_finans ordinaert_resultat_for_skatt aarsresultat sum_eiendeler sum_anleggsmidler
sum_omloepsmidler sum_egenkapital sum_innskutt_egenkapital sum_opptjent_egenkapital
sum_gjeld sum_kortsiktig_gjeld sum_langsiktig_gjeld
""".split()

ACCOUNT_KEY = [ORG, "regnskapstype", "periode_til"]

#: Nested role documents, one per company: groups of roles, each held by a person or a company.
ROLE_DOCUMENT = """
organisasjonsnummer string,
rollegrupper array<struct<
  type: struct<kode: string, beskrivelse: string>,
  sistEndret: string,
  roller: array<struct<
    type: struct<kode: string, beskrivelse: string>,
    rekkefolge: int, avregistrert: boolean, valgtAv: string,
    person: struct<
      navn: struct<fornavn: string, mellomnavn: string, etternavn: string>,
      fodselsdato: string, erDoed: boolean>,
    enhet: struct<
      organisasjonsnummer: string, navn: array<string>,
      organisasjonsform: struct<kode: string>, erSlettet: boolean>>>>>
"""

# Where each column of an account sits in the accounts API document.
ACCOUNT_PATHS = {
    "regnskapstype": ("regnskapstype", "string"),
    "periode_til": ("regnskapsperiode.tilDato", "date"),
    "periode_fra": ("regnskapsperiode.fraDato", "date"),
    "valuta": ("valuta", "string"),
    "oppstillingsplan": ("oppstillingsplan", "string"),
    "morselskap": ("virksomhet.morselskap", "boolean"),
    "avviklingsregnskap": ("avviklingsregnskap", "boolean"),
    "ikke_revidert": ("revisjon.ikkeRevidertAarsregnskap", "boolean"),
    "fravalg_revisjon": ("revisjon.fravalgRevisjon", "boolean"),
    "smaa_foretak": ("regnkapsprinsipper.smaaForetak", "boolean"),
    "regnskapsregler": ("regnkapsprinsipper.regnskapsregler", "string"),
    "sum_driftsinntekter": ("resultatregnskapResultat.driftsresultat.driftsinntekter.sumDriftsinntekter", "amount"),
    "sum_driftskostnad": ("resultatregnskapResultat.driftsresultat.driftskostnad.sumDriftskostnad", "amount"),
    "driftsresultat": ("resultatregnskapResultat.driftsresultat.driftsresultat", "amount"),
    "sum_finansinntekter": ("resultatregnskapResultat.finansresultat.finansinntekt.sumFinansinntekter", "amount"),
    "sum_finanskostnad": ("resultatregnskapResultat.finansresultat.finanskostnad.sumFinanskostnad", "amount"),
    "netto_finans": ("resultatregnskapResultat.finansresultat.nettoFinans", "amount"),
    "ordinaert_resultat_for_skatt": ("resultatregnskapResultat.ordinaertResultatFoerSkattekostnad", "amount"),
    "aarsresultat": ("resultatregnskapResultat.aarsresultat", "amount"),
    "sum_eiendeler": ("eiendeler.sumEiendeler", "amount"),
    "sum_anleggsmidler": ("eiendeler.anleggsmidler.sumAnleggsmidler", "amount"),
    "sum_omloepsmidler": ("eiendeler.omloepsmidler.sumOmloepsmidler", "amount"),
    "sum_egenkapital": ("egenkapitalGjeld.egenkapital.sumEgenkapital", "amount"),
    "sum_innskutt_egenkapital": ("egenkapitalGjeld.egenkapital.innskuttEgenkapital.sumInnskuttEgenkaptial", "amount"),
    "sum_opptjent_egenkapital": ("egenkapitalGjeld.egenkapital.opptjentEgenkapital.sumOpptjentEgenkapital", "amount"),
    "sum_gjeld": ("egenkapitalGjeld.gjeldOversikt.sumGjeld", "amount"),
    "sum_kortsiktig_gjeld": ("egenkapitalGjeld.gjeldOversikt.kortsiktigGjeld.sumKortsiktigGjeld", "amount"),
    "sum_langsiktig_gjeld": ("egenkapitalGjeld.gjeldOversikt.langsiktigGjeld.sumLangsiktigGjeld", "amount"),
    "brreg_id": ("id", "bigint"),
    "journalnr": ("journalnr", "bigint"),
}

# Positions of the fields used from the accounts history dump, and how many it must have.
DUMP_POSITIONS = {
    "orgnr": 0, "aar": 1, "mnd": 2, "sum_driftsinntekter": 3, "driftsresultat": 10,
    "sum_finansinntekter": 11, "sum_finanskostnad": 14, "ordinaert_resultat_for_skatt": 16,
    "aarsresultat": 23, "sum_anleggsmidler": 28, "sum_omloepsmidler": 35, "sum_egenkapital": 43,
    "sum_innskutt_egenkapital": 44, "sum_gjeld": 45, "sum_langsiktig_gjeld": 46, "sum_kortsiktig_gjeld": 50,
}
DUMP_FIELDS = 51

# Change types of the feed that retire a company.
DELETION_TYPES = ("Sletting", "Fjernet")
