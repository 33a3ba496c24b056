"""Texts with known personal data, made from values of labelled columns and templates written for this purpose.

The field is fitted on such texts only: which characters are personal data is known from how the text was made, not from
any pattern. Values of columns whose names say what they hold (``full_name``, ``phone``, ``ssn``, ``address``, ``email``,
``company``, ``project``, ``dataset``, ``ref``, ``remark``, ``city``) fill the slots, along with names of other countries,
identity numbers made by rule, and things that look like personal data but are none. A share of the templates is held out.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

from lodescan.llm.pii_patterns import GIVEN

#: slots that are personal data, and their types
ENTITY = {"NAME": "NAME", "PHONE": "PHONE", "EMAIL": "EMAIL", "ID": "ID_NUMBER", "LID": "ID_NUMBER", "AID": "ID_NUMBER", "ADDRESS": "ADDRESS"}

# Families of many countries, beside those of the columns.
FAMILIES = """
Smith Johnson Williams Brown Jones Garcia Miller Davis Martinez Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker
Young King Wright Scott Green Baker Adams Nelson Hill Campbell Mitchell Roberts Carter Phillips Evans Turner Parker Collins Edwards Stewart Morris Murphy
Cook Rogers Morgan Cooper Peterson Bailey Reed Kelly Howard O'Connor O'Brien McDonald Schmidt Müller Schneider Fischer Weber Wagner Becker Hoffmann Koch
Dubois Moreau Lefèvre Laurent Girard Rossi Russo Ferrari Esposito Silva Santos Oliveira Costa Fernández Rodríguez López González Jansen Bakker Visser
Andersson Johansson Nilsson Hansen Nielsen Kowalski Nowak Wiśniewski Yılmaz Demir Ivanov Petrova Tanaka Suzuki Sato Wang Zhang Chen Liu Patel Sharma
Singh Gupta Hassan Ibrahim Khan Okafor Mensah Nkosi Subramaniam Nguyen Kim Park
""".split()
SYLLABLES = ("bar kel mon tar vel dor fin gar hol lan mar nor pel quin ros sal tur wes yar zel bren crow dal esk".split(),
             "ton ley ford by wick mann stein sson ski wicz ez ini ard eau oglu dze yan uri berg field worth gate".split())

TEMPLATES = """
Please contact {NAME} or {NAME} about the {THING}.|Yesterday {NAME} met {NAME} in {CITY}.|My colleague {NAME} will call you back on {PHONE}.
{NAME} ({EMAIL}) reported the issue on {DATE}.|Forwarded by {TITLE} {NAME} to {EMAIL}.|The parcel was sent to {NAME}, {ADDRESS}.
She now lives at {ADDRESS} and her number is {PHONE}.|Name: {NAME}{NL}Phone: {PHONE}{NL}Address: {ADDRESS}|Customer {NAME}, {LABEL} {LID}, called twice.
{LABEL} {LID} belongs to {NAME}.|We verified {LABEL} {LID} for {NAME} on {DATE}.|{NAME} gave {ID} as identification.|The applicant wrote {ID} on the form.
Interview with {NAME}: all fine.|Approved by {NAME}, {NAME} and {NAME}.|cc: {EMAIL}; {EMAIL}|Send the file to {EMAIL} before {DATE}.|Mail {EMAIL} or ring {PHONE}.
Office {PHONE}, mobile {PHONE}.|Tel {PHONE} fax {PHONE}|{NAME};{PHONE};{EMAIL};{NUM}|{NAME} | {PHONE} | {REF}|{NAME}{NL}{ADDRESS}{NL}{PHONE}
Deliver to {ADDRESS}, attention {TITLE} {NAME}.|He moved from {ADDRESS} to {ADDRESS} in {YEAR}.|The invoice address is {ADDRESS}.|{NAME}'s account was closed.
According to {NAME}, the {THING} is late.|Best regards, {NAME}|Dear {TITLE} {NAME}, thank you for your letter.|The witness {NAME} could not be reached under {PHONE}.
Owner: {NAME}{NL}Contact: {EMAIL}|user={EMAIL};phone={PHONE};id={NUM}|Herr {NAME} wohnt in der {ADDRESS}.|Bitte rufen Sie {NAME} unter {PHONE} an.
Die Adresse lautet {ADDRESS}.|Frau {NAME} hat die {LABEL} {LID} angegeben.|Ansprechpartnerin: {NAME} ({EMAIL})|Schreiben Sie an {EMAIL}.
Monsieur {NAME} habite au {ADDRESS}.|Rappeler {NAME} au {PHONE} avant le {DATE}.|Écrivez à {EMAIL} pour le dossier {REF}.|La cliente {NAME} demeure {ADDRESS}.
La señora {NAME} vive en {ADDRESS}.|Llame a {NAME} al {PHONE}.|Escriba a {EMAIL} sobre el expediente {REF}.|El titular {NAME} presentó {LABEL} {LID}.
Signed: {NAME} and {NAME}, {DATE}|From: {NAME} <{EMAIL}>|To: {EMAIL}, {EMAIL}|[{DATE}] {NAME} logged in from {IP}|mailto:{EMAIL}?subject={REF}
the note says "{LABEL} {LID}" and nothing else|Both {LABEL} {LID} and {LABEL} {LID} were on page {NUM}.|The clerk read {ID} and {ID} aloud.|The passenger showed {ID} at the gate.
The caller confirmed {ID} and hung up.|Record at {IP} holds {LABEL} {LID}.|Badge of {NAME} returned, new one goes to {ADDRESS}, see {REF}.
{TITLE} {NAME} was out when the driver came to {ADDRESS} on {DATE}.|Tenant {NAME} asked for the keys.|Duplicate of {NAME} / {NAME}, same {PHONE}.
{NAME} {REF} {DATE} {NUM}|{REF} {TITLE} {NAME} {DATE} {NUM}|Last seen: {NAME}, {PHONE}, {EMAIL}|text me at {PHONE} ok?|ping {PHONE} or {EMAIL} asap
The {THING} of {NAME} was corrected because {NAME} complained.|ask {NAME} first|new user {NAME} => {EMAIL}|reach her at {EMAIL} or {PHONE}
The member wrote: my number is {PHONE}, my house is {ADDRESS}.|{NAME} disputes it, {ID}.|{NAME} disputes it, {LABEL} {LID}.|Guarantor {NAME} ({LABEL} {LID})
{OPENER} {LABEL} {LID} and {AID} {FOLLOW}.|{LABEL} {LID}, {AID} and {AID} {FOLLOW} {NUM}.|{FOLLOW} {LABEL} {LID} or {AID}|{OPENER} {NAME} {FOLLOW} {PHONE}.|{OPENER} {NAME} {FOLLOW} {THING}.|{OPENER} {NAME}.|{ROLE} {NAME} {FOLLOW} {ADDRESS}.|{ROLE} {NAME} {FOLLOW} {ID}.|{ROLE}: {NAME}
{OPENER} {NAME} {FOLLOW} {EMAIL}.|{OPENER} {PHONE} {FOLLOW} {NUM}.|{OPENER} {PHONE}, {FOLLOW}|{OPENER} {ADDRESS} {FOLLOW} {DATE}.|{OPENER} {ID}, {FOLLOW} {REF}.|{OPENER} "{ID}" {FOLLOW}
{OPENER} {ID} {FOLLOW} {ID}.|{OPENER} {ID} {FOLLOW} {LABEL} {LID} {FOLLOW} {NUM}.|{NAME} {FOLLOW} {ID} {FOLLOW} {THING}.|{FOLLOW}={PHONE};{FOLLOW}={EMAIL};{FOLLOW}={NUM}
{NAME} {VERB} the {THING} and {VERB} it.|{NAME} {VERB} {FOLLOW} the {THING}.|{NAME}, {FOLLOW} the {THING}, {VERB} again.|We have {VERB} {NAME} since {YEAR}.|If {NAME} {VERB}, {VERB} {NAME}.|{NAME} {VERB}.
Our {THING} {VERB} {NAME}, {FOLLOW} two.|The {THING} {VERB} {NAME} last year.|{NAME} {VERB} for {ORG} in {CITY}.|When {NAME} {VERB}, the {THING} was gone.|Write to {EMAIL} for a {THING} or phone {PHONE}.|They rented a {THING} at {ADDRESS}.
{CLOSING}, {NAME}|{CLOSING},{NL}{NAME}|{CLOSING}, {NAME}{NL}{ORG}|{CLOSING},{NL}{NAME}{NL}{ORG}|They have lived at {ADDRESS} with two dogs.|We stay at {ADDRESS} until {DATE}.|{OPENER} {ADDRESS} since {YEAR}.
Regards,{NL}{NAME}{NL}{ORG}{NL}{PHONE}|Name: {NAME}{NL}Tel. {PHONE}{NL}Addr.: {ADDRESS}|{OPENER} {NAME}, {FOLLOW} {ADDRESS}, {FOLLOW}.|**{OPENER}**: {NAME}  **{OPENER}**: {PHONE}
{OPENER} {NAME} / {NAME}, {FOLLOW} {PHONE}.|{OPENER} {EMAIL}, {FOLLOW} {EMAIL}|{OPENER} {NAME} {FOLLOW} {NAME} {FOLLOW} {DATE}.|{OPENER} {ADDRESS}, {FOLLOW} {REF}.
{NUM} {TITLE} {NAME} {DATE} {NUM}|{REF} {NAME} {DATE} {NUM}|{OPENER} {NAME} ({EMAIL}) {FOLLOW}.|{OPENER} {NAME} {FOLLOW} {LABEL} {LID} {FOLLOW}.|{NAME} {FOLLOW} {EMAIL}.|{NAME} {FOLLOW} {THING}.
""".strip()
DECOYS = """
Order {REF} shipped on {DATE}, tracking {LONG}.|Invoice {REF} of {DATE} was paid.|The field {WORD} contains {REF}, {REF} and {REF}.|Ticket {REF} is a copy of {REF}.
Job {NUM} took {NUM} ms on {IP}.|Version {VERSION} replaces {VERSION}.|Digest {HASH} is wrong.|Server {IP} replied after {NUM} ms.|Batch {NUM} had {NUM} rows.
{ORG} extended its contract until {DATE}.|{ORG} moved to {UNIT}.|The depot of {ORG} is closed.|{PROJECT} was left out of the run.|{PROJECT} starts on {DATE}.
Exception for {DATASET} since {YEAR}.|see {DATASET} for details|The {STREETNAME} dataset has {NUM} columns.|Cluster {GIVEN}-{NUM} restarted.|Release {GIVEN} {VERSION} is out.
Meeting room {WORDCAP} {NUM}, floor {SMALL}.|Nothing new in {UNIT}.|No address was given.|The phone field is blank.|Name: Not Applicable|Company name: {ORG}
Bank Name: {ORG}|Product name: {WORDCAP} {WORDCAP}|The column {WORD} is empty in {UNIT}.|{REMARK}|{REMARK}|{REMARK} {REMARK}|Der Auftrag {REF} ist abgeschlossen.
Le contrôle {REF} est fini.|El lote {NUM} tardó {NUM} ms.|Version {VERSION} ist frei.|La version {VERSION} remplace {VERSION}.|Range {NUM}-{NUM} is kept, {NUM}.{NUM} is not.
seen again under {ORG}, no action|vendor on file ({ORG})|The gateway logged {NUM} bounces at {EPOCH}.|import of {UNIT} ended with build {VERSION} at {EPOCH}
Parking on {STREETNAME} is free.|Use {PACKAGE} in the image.|@{WORD} please check {REF}|Chemical name: {WORDCAP} {WORDCAP}|Customer: Sure, it works again.|Street and city are optional.
The {WORDCAP} {WORDCAP} report is ready.|Call the function from the {THING}.|It was {WORDCAP} who said so.|We visited {CITY} and {CITY} in {YEAR}.|Passport column removed, see {REF}.
{OPENER} {ORG} {FOLLOW} {DATE}.|{OPENER} {REF} {FOLLOW} {NUM}.|{OPENER} {NUM} {FOLLOW} {THING}.|{OPENER} {WORDCAP} {FOLLOW}.|{OPENER} {PROJECT} {FOLLOW} {DATE}.|{OPENER} {CITY} {FOLLOW}.
{FOLLOW} {REF} and {REF}|{OPENER} {EPOCH} {FOLLOW} {IP}.|{OPENER} {LONG} {FOLLOW}.|{ROLE} and {ROLE} {FOLLOW} {THING}.|{ROLE}: Not Applicable.|{OPENER} {THING} {FOLLOW} {UNIT}.
The {THING} {VERB} the {THING}.|We {VERB} a {THING} for the {THING}.|{WORDCAP} {VERB} the {THING}.|{PROPER} {VERB} the {THING}.|{ORG} {VERB} a {THING}.|Write to us for a {THING}, or {VERB}.|The new {THING} {VERB} in {YEAR}.
The {PROPER} {FOLLOW} {THING}.|We passed the {PROPER} on {DATE}.|{OPENER} the {PROPER} {FOLLOW}.|{PROPER} {FOLLOW} {CITY}.|They flew to {PROPER} and back.
Our office in {CITY} opens at nine.|The {WORDCAP} Foundation and the University of {CITY} agreed.|Social security is discussed in chapter {SMALL}.|Page {NUM} of {NUM}
""".strip()
# Words that sentences begin and go on with, in several languages, and parts that people have in them.
OPENERS = """
Please ask|Today|Yesterday|Witness|Borrower|Then|Bitte|Heute kam|Gestern|Anruf von|Frage an|Appeler|Rappeler|Merci à|Demain|Client|Llamar a|Llame a|Hoy|Ayer vino|La titular es|Le client|Il signor
Chiamare|Oggi|Met|Saw|Called by|Message from|Voicemail from|Text from|Callback to|Call|Fax|Cell|Signed by|Checked by|Ship to|Send to|Letter for|Parcel for|Moved from|New address|Neue Anschrift|Adresse|Domicilio
Found|It lists|The page shows|Form with|Record holds|Kept|Seen|Noted|Reads|The user said|Field|Im Feld|En el campo|Dans le champ|Both|Only|Last caller|Contact|Duplicate|See|Ref|Order|Owner|Since|Nach|Avant|With
""".replace("\n", "|").strip("|").split("|")
FOLLOWS = """
called back under|lives at|will answer|was out|asked about|disputes|confirmed|wohnt|meldet sich per|unter|habite|au|al|vive en|domicilio|con|and|und|et|y|or|with|via|from page|at|on|for|is|ist|es|est|same phone|no name left|in the chat
laut Akte|with reference|checked by|masked later|typed it twice|over the phone|can be reached under|received|tel|phone|contact|seq|before|vor|avant|antes|replied|the next day|then|who|whose|was late|left a note|zurückrufen|abholen
""".replace("\n", "|").strip("|").split("|")
PROPERS = """
Old Mill|Red Cross|Golden Gate|New York|Hong Kong|Los Angeles|Black Sea|Town Hall|Supreme Court|World Bank|North Station|Central Park|Grand Hotel|Royal Society|White House|Silk Road|Blue Lake
United Nations|Great Wall|Green Party|Holy Grail|First Aid|Open Source|Data Protection Act|High Street|South Africa|San Marino|Saudi Arabia|Costa Rica|Middle Ages|Prime Minister|Social Security
""".replace("\n", "|").strip("|").split("|")
CLOSINGS = ["Sincerely", "Regards", "Kind regards", "Best wishes", "Thanks", "Yours", "Cheers", "Mit freundlichen Grüßen", "Cordialement", "Saludos"]
VERBS = """
opened|closed|said|left|works|worked|presented|told|knew|known|saw|seen|met|read|wrote|signed|brought|found|lost|asked|answered|called|came|went|lives|thinks|wants|made|took|gave|heard|won|sold|bought|plays|taught
travaille|a dit|arrive|parle|arbeitet|sagte|kam|schrieb|liest|wohnt|trabaja|dijo|llega|escribe|lavora|ha detto|explained|noticed|promised|forgot|paid|moved|agreed|smiled|waited|travelled|cooked|fixed|is|was|has|had
""".replace("\n", "|").strip("|").split("|")
ROLES = "Borrower Witness Tenant Client Patient Member Applicant Guarantor Driver Seller Buyer Nurse Doctor Manager Passenger Student Teacher Caller Owner Guest Kunde Patientin Mieter Cliente Titular Locataire".split()
THINGS = "report invoice contract table delivery payment form meeting release check dashboard key notebook door letter bank flat house novel guest book train school office garden bridge price team plan".split()
UNITS = ["pg/main.users", "mongo/crm.visits", "s3/exports#payroll.csv", "mssql/dbo.people", "dynamo/eu.leads", "cosmos/support.tickets", "bucket/logs"]
PACKAGES = ["numpy@1.26.4", "left-pad@1.3.0", "org.apache:commons@3.1", "lib@2.0.1"]
LABELS = {
    "ssn": ["SSN", "SSN:", "social security number", "soc. sec. no.", "ssn="], "pesel": ["PESEL", "PESEL:"], "nif": ["NIF", "DNI", "DNI/NIF:", "NIE"],
    "aadhaar": ["Aadhaar", "aadhaar:", "UID no."], "nhs": ["NHS number", "nhs_number=", "NHS No."], "tax": ["Steuer-ID", "IdNr.", "tax ID (DE)", "tax no."],
    "passport": ["Passport:", "passport no.", "travel document (passport)", "Reisepass"],
}


def templates(held_out: bool | None = None) -> tuple[list[str], list[str]]:
    """Templates with personal data and without; every fifth is held out of the fit."""
    parts = [[t for t in re.split(r"[|\n]", block.replace(" | ", " ¦ ")) if t] for block in (TEMPLATES, DECOYS)]
    parts = [list(dict.fromkeys(t.replace("¦", "|") for t in p)) for p in parts]
    if held_out is None:
        return parts[0], parts[1]
    return tuple([t for i, t in enumerate(p) if (i % 5 == 4) == held_out] for p in parts)


class Maker:
    """Makes texts; ``columns``: values by column name."""

    def __init__(self, columns: dict[str, list[str]], seed: int = 3):
        self.rng, self.columns = random.Random(seed), columns

    def pick(self, column: str, other: str) -> str:
        values = self.columns.get(column)
        return self.rng.choice(values) if values else other

    def made_family(self) -> str:
        r = self.rng
        return r.choice(SYLLABLES[0]).capitalize() + (r.choice(SYLLABLES[0]) if r.random() < 0.3 else "") + r.choice(SYLLABLES[1])

    def name(self) -> str:
        r = self.rng
        parts = self.pick("full_name", "").split()
        if r.random() < 0.04:
            return " ".join([r.choice(GIVEN).capitalize(), r.choice(GIVEN).capitalize(), r.choice(FAMILIES)])
        if len(parts) != 2 or r.random() < 0.45:
            given = r.choice(GIVEN).capitalize() if r.random() < 0.6 else r.choice(SYLLABLES[0]).capitalize() + r.choice(["a", "o", "en", "ia", "ek", "is"])
            parts = [given, r.choice(FAMILIES) if r.random() < 0.5 else self.made_family()]
        given, family = parts
        if r.random() < 0.14:
            family = f"{family}-{self.made_family()}"
        if r.random() < 0.06:
            family = r.choice(["de ", "van ", "von ", "al-", "O'", "D'", "del ", "di "]) + family
        initial = r.choice("ABCDEFGHJKLMNRSTVW") + "."
        form = r.random()
        whole = (
            f"{given} {family}" if form < 0.56 else f"{given[0]}. {family}" if form < 0.7 else f"{family}, {given}" if form < 0.78 else f"{given} {initial} {family}"
            if form < 0.86 else f"{family}, {given[0]}." if form < 0.89 else f"{initial}{r.choice([' ', ''])}{given[0]}. {family}" if form < 0.91 else f"{family} {given}" if form < 0.93 else f"{given} {family}"
        )
        case = r.random()
        return whole.lower() if case < 0.07 else whole.upper() if case < 0.12 else whole

    def digits(self, form: str) -> str:
        return "".join(str(self.rng.randrange(10)) if c == "9" else self.rng.choice("ABCDEFGHJKLMNPQRSTVWXYZ") if c == "A" else c for c in form)

    def phone(self) -> str:
        r = self.rng
        if r.random() < 0.5:
            return self.pick("phone", "") or self.digits("+44 20 9999 9999")
        return self.digits(r.choice([
            "+1 999 999 9999", "(999) 999-9999", "999-999-9999", "1-999-999-9999", "999.999.9999", "+44 (0)20 9999 9999", "+4930999999", "0044 20 99999999", "+49 30 99999999", "030/9999-9999",
            "+33 1 99 99 99 99", "01 99 99 99 99", "01.99.99.99.99", "+91 99999 99999", "07799 999999", "+34 999 999 999", "0999 999 9999", "020 9999 9999", "030 99999 999", "0049 30 99999 999", "+19995559999",
        ]))

    def identity(self) -> tuple[str, str]:
        """Kind and value of an identity number."""
        r = self.rng
        kind = r.choice(list(LABELS))
        if kind == "ssn" and r.random() < 0.5:
            return kind, self.pick("ssn", self.digits("999-99-9999"))
        forms = {
            "ssn": ["999-99-9999", "999 99 9999", "999.99.9999"], "pesel": ["99999999999"], "nif": ["99999999A", "99999999-A", "X9999999A", "99999999 A"],
            "aadhaar": ["9999 9999 9999", "999999999999", "9999-9999-9999"], "nhs": ["999 999 9999", "999-999-9999", "9999999999"],
            "tax": ["99 999 999 999", "99999999999", "99.999.999.999"], "passport": ["AA9999999", "A99999999", "AA999999"],
        }
        return kind, self.digits(r.choice(forms[kind]))

    def telling_identity(self) -> str:
        """A number whose form tells what it is even without a label."""
        while True:
            kind, value = self.identity()
            if kind in ("ssn", "nif") or kind == "aadhaar" and not value.isdigit() or kind == "tax" and not value.isdigit():
                return value

    def reference(self) -> str:
        r = self.rng
        if r.random() < 0.25:
            return self.pick("ref", self.digits("9999999999"))
        return self.digits(r.choice(["INV-999999", "#99999", "PO 9999/99", "AA-9999-99", "9999-99-9999", "A99999999", "REQ9999", "SR-99999", "9999/9999", "999999", "9999999999", "T99999999"]))

    def mail(self) -> str:
        r = self.rng
        value = self.pick("email", "") if r.random() < 0.5 else ""
        if "@" not in value:
            a, b = r.choice(GIVEN), (r.choice(FAMILIES) if r.random() < 0.5 else self.made_family()).lower()
            local = r.choice([f"{a}.{b}", f"{a[0]}.{b}", f"{b}{r.randrange(99)}", f"{a}_{b}", f"{a}+{r.choice(THINGS)}", a, f"{a}-{b[:4]}", f"{a[0]}{b}"])
            host = r.choice([f"{self.made_family().lower()}.test", f"mail.{self.made_family().lower()}.invalid", f"{self.made_family().lower()}-{r.choice(THINGS)}.example", "staff.example.org", "company.co.uk"])
            value = f"{local}@{host}"
        how = r.random()
        if how < 0.8:
            return value.upper() if how < 0.08 else value
        local, _, host = value.partition("@")
        dot, at = r.choice([(".", " [at] "), (" [dot] ", " [at] "), (" dot ", " at "), (" dot ", " (at) "), (".", "(at)"), (" (dot) ", " (at) "), (".", " {at} ")])
        return local + at + host.replace(".", dot)

    def address(self) -> str:
        r = self.rng
        if r.random() < 0.55:
            return self.pick("address", "") or "12 Oak Road"
        town = self.pick("city", "") or self.made_family()
        no, name = f"{r.randrange(1, 250)}{r.choice(['', '', '', 'a', 'b'])}", self.made_family()
        two = f"{name} {r.choice(['Tree', 'Park', 'Hill', self.made_family()])}" if r.random() < 0.3 else name
        return r.choice([
            f"{no} {two} {r.choice(['Street', 'Road', 'Lane', 'Way', 'Terrace', 'Place'])}", f"{no} rue de la {two}", f"{r.choice(['Calle', 'Avenida', 'Via', 'Plaza'])} {r.choice(['', 'de la ', 'del '])}{two}{r.choice([' ', ', '])}{no}", f"{no}, boulevard du {two}, {self.digits('99999')} {town}",
            f"{no} {name} {r.choice(['Street', 'Road', 'Avenue', 'Lane', 'Drive', 'St', 'Court'])}", f"{no} {name} {r.choice(['Street', 'Road', 'Mews'])}, {town}",
            f"{no} {name} Avenue, {r.choice(['Apt', 'Suite', 'Flat'])} {r.randrange(1, 90)}, {town}, {self.digits('AA 99999')}", f"Flat {r.randrange(1, 30)}, {no} {name} Close, {town} {self.digits('AA9 9AA')}",
            f"{no}, rue de {name}, {self.digits('99999')} {town}", f"{no} avenue du {name}", f"{name}straße {no}", f"{name}gasse {no}, {self.digits('99999')} {town}", f"{name}weg {no}", f"{name}str. {no}, {self.digits('99999')} {town}", f"{name}str. {no}",
            f"{no} {name} Boulevard #{r.randrange(1, 30)}, {town}, {self.digits('AA 99999')}", f"{no} bis chemin des {name}", f"Am {name}platz {no}, {self.digits('99999')} {town}",
        ])

    def date(self) -> str:
        y, m, d = self.rng.randrange(2012, 2026), self.rng.randrange(1, 13), self.rng.randrange(1, 29)
        return self.rng.choice([f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{m}/{d}/{y}", f"{d} May {y}", f"spring {y}"])

    def filled(self, slot: str, people: list[str]) -> str:
        r = self.rng
        if slot == "NAME":
            if people and r.random() < 0.35:
                return r.choice(people)
            people.append(self.name())
            return people[-1]
        own = {
            "PHONE": self.phone, "EMAIL": self.mail, "ADDRESS": self.address, "REF": self.reference, "DATE": self.date, "ID": self.telling_identity, "AID": lambda: self.identity()[1],
            "TITLE": lambda: r.choice(["Mr", "Mr.", "Mrs", "Ms", "Ms.", "Dr.", "Prof.", "Miss"]), "THING": lambda: r.choice(THINGS), "CITY": lambda: self.pick("city", "") or self.made_family(),
            "OPENER": lambda: r.choice(OPENERS), "FOLLOW": lambda: r.choice(FOLLOWS), "PROPER": lambda: r.choice(PROPERS), "VERB": lambda: r.choice(VERBS), "CLOSING": lambda: r.choice(CLOSINGS), "ROLE": lambda: r.choice(ROLES), "NUM": lambda: str(r.randrange(10, 9999)), "SMALL": lambda: str(r.randrange(1, 12)), "YEAR": lambda: str(r.randrange(2000, 2026)), "LONG": lambda: self.digits("999999999999"),
            "EPOCH": lambda: self.digits(r.choice(["1599999999", "1699999999999", "1499999999"])), "IP": lambda: f"10.{r.randrange(255)}.{r.randrange(255)}.{r.randrange(255)}",
            "VERSION": lambda: f"{r.randrange(9)}.{r.randrange(40)}.{r.randrange(99)}", "HASH": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([12, 32, 40]))),
            "ORG": lambda: self.pick("company", "") if r.random() < 0.6 and self.columns.get("company") else f"{r.choice([self.made_family(), r.choice(FAMILIES)])} {r.choice(['Foods', 'Systems', 'Travel', 'Media', 'Holdings', 'Logistics', 'Clinic'])} {r.choice(['Ltd', 'GmbH', 'Inc.', 'S.A.', 'AB', 'LLC', 'OOO', 'AO', 'BV'])}",
            "PROJECT": lambda: self.pick("project", f"Project {self.made_family()}"), "DATASET": lambda: self.pick("dataset", f"{self.made_family().lower()}-export-v{r.randrange(9)}"),
            "UNIT": lambda: r.choice(UNITS), "WORD": lambda: r.choice(["ref", "id", "notes", "status", "triage", "code"]), "WORDCAP": lambda: r.choice([self.made_family(), "Annual", "Northern", "Ethyl", "Copper", "Tarnate", "Quarterly"]),
            "GIVEN": lambda: r.choice([r.choice(GIVEN).capitalize(), (self.pick("full_name", "Ana") or "Ana").split()[0]]), "STREETNAME": lambda: f"{self.made_family()} {r.choice(['Street', 'Road', 'Lane'])}",
            "REMARK": lambda: self.pick("remark", "Nothing else was noted."), "PACKAGE": lambda: r.choice(PACKAGES), "NL": lambda: "\n",
        }
        return own[slot]()

    def sentence(self, template: str, people: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans, label = "", [], None
        for piece in re.split(r"(\{[A-Z]+\})", template):
            slot = piece[1:-1] if piece[:1] == "{" else None
            if slot is None:
                out += piece
                continue
            if slot == "LABEL":
                label = self.identity()
                word = self.rng.choice(LABELS[label[0]])
                out += word
                continue
            value = (label or self.identity())[1] if slot == "LID" else self.filled(slot, people)
            if slot == "LID" and out.endswith("= "):
                out = out[:-1]
            if slot in ENTITY and value:
                spans.append((len(out), len(out) + len(value), ENTITY[slot]))
            out += value
        return out, spans

    def text(self, with_data: list[str], without: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
        """One to nine sentences, about half of them without personal data; people come back within a text."""
        r, out, spans, people = self.rng, "", [], []
        glue = r.choice([" ", " ", "\n", "\n- ", " | ", "  "])
        for i in range(r.choice([1, 1, 2, 3, 4, 6, 9])):
            piece, found = self.sentence(r.choice(with_data if r.random() < 0.5 else without), people)
            lead = glue if i else r.choice(["", "", "- ", "* ", "| ", "**Note** "])
            spans += [(a + len(out) + len(lead), b + len(out) + len(lead), k) for a, b, k in found]
            out += lead + piece
        return out, spans


def texts(columns: dict[str, list[str]], n: int, seed: int, held_out: bool) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    maker, (with_data, without) = Maker(columns, seed), templates(held_out)
    for _ in range(n):
        yield maker.text(with_data, without)
