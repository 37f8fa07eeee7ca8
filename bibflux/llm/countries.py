"""Names by which people call the countries of a reference list.

One line per country: its ISO code, then short, formal and foreign names. Forms like "Republic of X" need no entry,
because X is found inside them. ``OTHERS`` are countries and regions that no such list need hold; naming them keeps
"Niger" from being read as a misspelt "Nigeria", and "North Korea" as a mention of "Korea".
"""

from __future__ import annotations

ALIASES = """
US United States|United States of America|USA|U.S.|U.S.A.|The States|America|Estados Unidos|Estados Unidos de América|EE. UU.|EEUU|EUA|États-Unis|États-Unis d'Amérique|Vereinigte Staaten|Vereinigte Staaten von Amerika|Stati Uniti|New Mexico|New Jersey|Georgia, USA
GB United Kingdom|UK|U.K.|Great Britain|Britain|England|Scotland|Wales|Northern Ireland|Reino Unido|Royaume-Uni|Vereinigtes Königreich|Regno Unito|Gran Bretaña|Grande-Bretagne|Großbritannien|Grã-Bretanha|Inglaterra|Angleterre
CN China|PRC|P.R. China|PR China|People's Republic of China|Mainland China|Zhongguo|Chine|República Popular China|República Popular de China|Volksrepublik China
DE Germany|Deutschland|Federal Republic of Germany|Fed. Rep. of Germany|FRG|BRD|Bundesrepublik Deutschland|Alemania|Alemanha|Allemagne|Germania
FR France|French Republic|République française|Francia|França|Frankreich|República Francesa
IT Italy|Italian Republic|Italia|Italie|Itália|Italien|Repubblica Italiana
ES Spain|Kingdom of Spain|España|Espagne|Espanha|Spanien|Spagna|Reino de España
CA Canada|Canadá|Kanada
AU Australia|Commonwealth of Australia|Australie|Australien|Austrália
JP Japan|Nippon|Nihon|Japón|Japon|Japão|Giappone
KR South Korea|Republic of Korea|Korea|ROK|S. Korea|Korea, South|Korea, Republic of|Corea del Sur|República de Corea|Corée du Sud|Südkorea|Coreia do Sul|Hanguk|Daehan Minguk
BR Brazil|Brasil|Brésil|Brasilien|Brasile|Federative Republic of Brazil
IN India|Bharat|Inde|Indien|Índia
NL Netherlands|The Netherlands|Holland|Nederland|Países Bajos|Países Baixos|Pays-Bas|Niederlande|Holanda|Hollande|Paesi Bassi
CH Switzerland|Swiss Confederation|Schweiz|Suisse|Svizzera|Suiza|Suíça|Confoederatio Helvetica|Confédération suisse
SE Sweden|Sverige|Suecia|Suède|Schweden|Suécia|Svezia
NO Norway|Norge|Noreg|Noruega|Norvège|Norwegen|Norvegia
DK Denmark|Danmark|Dinamarca|Danemark|Dänemark|Danimarca
FI Finland|Suomi|Finlandia|Finlande|Finnland|Finlândia
PT Portugal|Portuguese Republic|República Portuguesa|Portogallo
BE Belgium|België|Belgique|Belgien|Bélgica|Belgio
AT Austria|Österreich|Oesterreich|Autriche|Áustria
PL Poland|Polska|Polonia|Pologne|Polen|Polônia|Rzeczpospolita Polska
RU Russia|Russian Federation|Rossiya|Rusia|Russie|Russland|Rússia|Federación de Rusia|Federación Rusa|Fédération de Russie
TR Turkey|Türkiye|Turquía|Turquie|Türkei|Turquia|Turchia
CO Colombia|República de Colombia|Colombie|Kolumbien|Colômbia
MX Mexico|México|United Mexican States|Estados Unidos Mexicanos|Mexique|Mexiko|Messico
AR Argentina|Argentine Republic|Argentine|República Argentina|Argentinien
CL Chile|República de Chile|Chili
SG Singapore|Singapura|Singapur|Singapour
TW Taiwan|Chinese Taipei|Taiwan, Province of China|Republic of China|Taiwan ROC|Taiwán
HK Hong Kong|Hong Kong SAR|HKSAR|Hong Kong, China|Hongkong
NZ New Zealand|Aotearoa|Nueva Zelanda|Nueva Zelandia|Nouvelle-Zélande|Neuseeland|Nova Zelândia
SA Saudi Arabia|KSA|Kingdom of Saudi Arabia|Arabia Saudita|Arabia Saudí|Arabie saoudite|Saudi-Arabien|Arábia Saudita
IL Israel|State of Israel|Israël
IR Iran|Islamic Republic of Iran|Irán|Irã|Persia
EG Egypt|Arab Republic of Egypt|Egipto|Égypte|Ägypten|Egito|Misr
ZA South Africa|RSA|Republic of South Africa|Sudáfrica|Afrique du Sud|Südafrika|África do Sul|Suid-Afrika
NG Nigeria|Federal Republic of Nigeria|Nigéria
KE Kenya|Kenia|Quênia
ID Indonesia|Republik Indonesia|Indonésie|Indonesien|Indonésia
MY Malaysia|Malasia|Malaisie|Malásia|Federation of Malaysia
TH Thailand|Kingdom of Thailand|Siam|Tailandia|Thaïlande|Tailândia|Prathet Thai
VN Vietnam|Viet Nam|Socialist Republic of Vietnam|Viêt Nam|Vietnã
PH Philippines|The Philippines|Pilipinas|Filipinas|Republic of the Philippines|Philippinen
PK Pakistan|Islamic Republic of Pakistan|Pakistán|Paquistão
BD Bangladesh|People's Republic of Bangladesh|People's Rep. of Bangladesh|Bangladés
GR Greece|Hellas|Hellenic Republic|Ellada|Grecia|Grèce|Griechenland|Grécia
CZ Czech Republic|Czechia|Česko|Česká republika|Czech Rep.|Rep. Checa|República Checa|Chequia|République tchèque|Tchéquie|Tschechien|Tschechische Republik
HU Hungary|Magyarország|Hungría|Hongrie|Ungarn|Hungria
RO Romania|România|Rumania|Rumanía|Roumanie|Rumänien|Romênia
UA Ukraine|Ukraina|Ukrayina|Ucrania|Ucrânia
HR Croatia|Hrvatska|Croacia|Croatie|Kroatien|Croácia
RS Serbia|Srbija|Serbie|Serbien|Sérvia
SK Slovakia|Slovak Republic|Slovensko|Eslovaquia|Slovaquie|Slowakei|Eslováquia
SI Slovenia|Slovenija|Eslovenia|Slovénie|Slowenien|Eslovênia
IE Ireland|Republic of Ireland|Éire|Irlanda|Irlande|Irland
PE Peru|Perú|República del Perú|Pérou
EC Ecuador|República del Ecuador|Équateur|Equador
MA Morocco|Kingdom of Morocco|Maroc|Marruecos|Marokko|Marrocos|Al Maghrib
AE United Arab Emirates|UAE|U.A.E.|Emirates|Emiratos Árabes Unidos|EAU|Émirats arabes unis|Vereinigte Arabische Emirate|Dubai|Abu Dhabi
GH Ghana
JO Jordan|Hashemite Kingdom of Jordan|Jordania|Jordanie|Jordanien|Jordânia
QA Qatar|State of Qatar|Catar|Katar
"""

OTHERS = (
    "Afghanistan|Albania|Algeria|American Samoa|Andorra|Angola|Antigua|Armenia|Azerbaijan|Bahamas|Bahrain|Barbados|Belarus|Belize|Benin|Bhutan|Bolivia|Bosnia|Botswana|Brunei|Bulgaria|Burkina Faso"
    "|Burma|Burundi|Cambodia|Cameroon|Cape Verde|Chad|Comoros|Congo|Costa Rica|Cuba|Cyprus|Djibouti|Dominica|Dominican Republic|East Timor|El Salvador|Equatorial Guinea|Eritrea|Estonia|Eswatini"
    "|Ethiopia|Fiji|Gabon|Gambia|Georgia|Grenada|Guatemala|Guinea|Guinea-Bissau|Guyana|Haiti|Honduras|Iceland|Iraq|Ivory Coast|Jamaica|Kazakhstan|Kiribati|Kosovo|Kuwait|Kyrgyzstan|Laos|Latvia|Lebanon"
    "|Lesotho|Liberia|Libya|Liechtenstein|Lithuania|Luxembourg|Macau|Macao|Macedonia|Madagascar|Malawi|Maldives|Mali|Malta|Mauritania|Mauritius|Micronesia|Moldova|Monaco|Mongolia|Montenegro|Mozambique"
    "|Myanmar|Namibia|Nauru|Nepal|Nicaragua|Niger|North Korea|Korea, North|DPRK|North Macedonia|Oman|Palau|Palestine|Panama|Papua New Guinea|Paraguay|Puerto Rico|Rwanda|Samoa|San Marino|Senegal|Seychelles"
    "|Sierra Leone|Somalia|South Sudan|Sri Lanka|Sudan|Suriname|Swaziland|Syria|Tajikistan|Tanzania|Togo|Tonga|Trinidad|Tunisia|Turkmenistan|Tuvalu|Uganda|Uruguay|Uzbekistan|Vanuatu|Vatican|Venezuela"
    "|Yemen|Zambia|Zimbabwe|Latin America|South America|North America|Central America"
).split("|")


def country_names(reference: list[tuple[int, str, str | None, str | None]]) -> tuple[list[tuple[int, str]], list[tuple[str, int]], list[str]]:
    """Names, codes and other entities for ``(country_id, country, iso2, iso3)`` rows of a reference list."""
    known = {line[:2]: line[3:].split("|") for line in ALIASES.strip().splitlines()}
    names, codes, listed = [], [], set()
    for country_id, country, iso2, iso3 in sorted(reference, key=lambda r: r[0]):
        if country:
            names.append((country_id, country))
            listed.add(country.lower())
        codes += [(c, country_id) for c in (iso2, iso3) if c]
        names += [(country_id, n) for n in known.get((iso2 or "").upper(), ())]
    return names, codes, [o for o in OTHERS if o.lower() not in listed]
