"""Problem 9: abusive, hateful or sexual content."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import rows

# Fixed lexicon: category -> (kind, weight of a find by itself, phrases). ``*`` stands for any ending of the word. The words are general ones
# of English, German, French and Spanish; what they add up to is settled by ``_RULES`` and ``THRESHOLD``.
_LEXICON = {
    # who is spoken to, spoken about, or means to act
    "you": ("", 0.0, "you|your|yours|yourself|youre|u r|ur|du|dich|dir|dein*|euch|euer|tu|toi|te|ton|ta|tes|vous|votre|vos|eres|ti|tus|usted|ustedes"),
    "them": ("", 0.0, "him|her|his|their|them|he|she|they|er|sie|ihn|ihnen|ihre*|lui|elle|ils|elles|leur|leurs|el|ella|ellos|ellas|su|sus|who wrote|whoever wrote|the person who|author|authors|maintainer|maintainers|reviewer|reviewers"),
    "will": ("", 0.0, "i will|i ll|im going to|i am going to|i m going to|gonna|we will|we ll|we are going to|someone will|somebody should|ich werde|wir werden|je vais|on va|nous allons|voy a|vamos a"),
    "like": ("", 0.0, "like|wie du|wie dich|comme toi|como tu"),
    # names for people that are an insult wherever they stand
    "vulgar": ("abuse", 3.0, """asshole*|arsehole*|shithead*|dickhead*|fuckhead*|fuckwit*|motherfuck*|dumbass*|dumbfuck*|jackass*|douchebag*|scumbag*|dirtbag*|bastard*|bitch|bitches|son of a bitch|cunt|cunts|twat|twats|wanker*|prick|whore|whores|slut|sluts|skank*|retard|retards|moron|morons|imbecile*|cretin*|halfwit*|half wit|dimwit*|nitwit*|numbskull*|dipshit*|piece of shit|pieces of shit|cocksucker*|fuck you|fuck off|fuck yourself|go fuck|screw you|eat shit|kiss my ass|suck my dick
        arschloch*|arschlöcher*|hurensohn*|hurensöhne|wichser*|missgeburt*|vollidiot*|vollpfosten|drecksau*|dreckskerl*|miststück*|fotze*|schlampe*|stück dreck|stück scheiße|fick dich|leck mich am arsch|verpiss dich|spast|spasti|halt die fresse|halts maul|halt s maul|halt dein maul|halt das maul
        connard*|connasse*|salaud*|salopard*|salope*|enculé*|fils de pute|ta gueule|vos gueules|pauvre con|sale con|gros con|petit con|abruti*|crétin*|trou du cul|va te faire foutre|va te faire enculer|nique ta mère|nique toi|tête de con|bouffon*|pétasse*|sale pute
        gilipollas|cabrón|cabrones|cabrona|hijo de puta|hijos de puta|hija de puta|pendejo*|pendeja*|subnormal|subnormales|imbécil|imbéciles|capullo*|mamón|malparido*|comemierda*|zorra asquerosa|puta madre|vete a la mierda|que te jodan|que te den|jódete|chinga tu madre|pedazo de mierda|cállate la boca"""),
    # names that become one beside an address, an adjective or one another
    "name": ("abuse", 1.3, """idiot|idiots|fool|fools|loser|losers|pig|pigs|parasite*|leech*|scum|clown|clowns|coward|cowards|freak|freaks|creep|creeps|degenerate|degenerates|maggot|maggots|vermin|cockroach*|dunce|buffoon*|simpleton*|lowlife*|trash|garbage|filth|rat|rats|dog|dogs|swine|ape|apes|monkey|lunatic*|psycho*|crybaby|failure|disgrace|nobody|waste of space|waste of air|waste of oxygen|waste of skin
        idiot|idioten|dummkopf|dummköpfe|trottel|schwein|schweine|versager*|depp|deppen|abschaum|dreck|penner|nichtsnutz*|feigling*|ratte|ratten|hund|affe|lappen|opfer|blödmann
        idiote|idiotes|imbécile*|ordure|ordures|porc|porcs|débile|débiles|minable*|nullard*|incapable|incapables|déchet|déchets|clochard*|lâche|larve|vermine
        idiota|idiotas|tonto|tontos|basura|cerdo|cerda|cerdos|escoria|inútil|inútiles|desgraciad*|payaso*|cobarde*|rata|ratas|bruto|parásito*|fracasad*"""),
    "slight": ("abuse", 0.5, """stupid|stupidest|worthless|pathetic|brainless|spineless|mindless|filthy|disgusting|useless|ugly|dumb|dumbest|miserable|vile|retarded|fucking|rotten|repulsive|incompetent|clueless|fat|lazy|ignorant|inbred|braindead|talentless|gutless|revolting|bloody|goddamn|sorry excuse|moronic|idiotic
        dumm|dumme|dummer|dummes|dummen|blöd|blöde*|elend*|widerlich*|erbärmlich*|wertlos*|hässlich*|ekelhaft*|nutzlos*|verdammt*|unfähig*|hirnlos*|faul*
        sale|sales|pauvre|pauvres|stupide*|bête|bêtes|inutile*|répugnant*|dégoûtant*|minable*|pathétique*|moche|fichu*|putain de|espèce de|espèces de|bande de|tas de|incapable*|gros
        estúpid*|asqueros*|maldit*|patétic*|miserable*|repugnante*|inútil*|feo|fea|pedazo de|puto|puta|puñetero|jodid*|sucio|sucia"""),
    "hush": ("abuse", 1.3, "shut up|shut the fuck up|shut your mouth|shut your face|shut your trap|get lost|piss off|bugger off|hau ab|verzieh dich|halt die klappe|halt den mund|la ferme|ferme la|ferme ta|casse toi|dégage|tire toi|cállate|callate|lárgate|cierra la boca|cierra el pico"),
    "scorn": ("abuse", 3.0, """nobody would miss you|no one would miss you|nobody will miss you|nobody likes you|nobody here likes you|no one likes you|everyone hates you|everybody hates you|we all hate you|i hate you|nobody can stand you|nobody here can stand you|no one can stand you|laughs at you behind|laughing at you behind|laugh at you behind|you make me sick|you make me want to|you disgust me|you make me puke|i despise you|better off without you|better place without you|better without you|you should be ashamed of existing|trained monkeys could|dropped you on|dropped on your head|your mother should|your mother must|your parents must|go cry to|cry to your|cry to mommy|horse you rode|crawl back|crawl under|the rock you crawled|you are nothing|you re nothing|you were never wanted|you are a joke|too stupid to live|too dumb to live|should never have been born|never been born|brain of a|iq of a|uninstall life|neck yourself
        du bist nichts|keiner mag dich|niemand mag dich|niemand will dich|keiner will dich|du ekelst mich|du widerst mich|geh weinen|zu dumm zum|zu blöd zum
        personne ne veut de toi|personne ne t aime|tu me dégoûtes|tu me degoutes|tu me donnes envie de vomir|tu ne vaux rien|tu ne sers à rien|tu es nul|t es nul|va pleurer
        me das asco|das asco|dais asco|nadie te quiere|nadie te soporta|no vales nada|no sirves para nada|eres una mierda|eres un mierda|eres una vergüenza"""),
    # wishes of death, threats
    "death": ("abuse", 3.4, """kill yourself|kill urself|kys|go die|please die|just die already|hope you die|hope you get cancer|hope he dies|hope she dies|hope they die|wish you were dead|wish you would die|wish you dead|hurry up and die|drop dead|rot in hell|burn in hell|go to hell|rot there|hang yourself|drink bleach|jump off a bridge|jump off a roof|jump off a cliff|end your life|slit your wrists|should have been aborted|deserve to die|deserves to die|do the world a favour and|do the world a favor and|do everyone a favour and|do everyone a favor and|choke on|die in a fire|die slowly
        verreck*|krepier*|geh sterben|stirb endlich|bring dich um|häng dich auf|erhäng dich|fahr zur hölle|du sollst sterben
        va crever|crève donc|crève sale|crève charogne|crève connard|crevez tous|va mourir|suicide toi|va te pendre|pends toi|tue toi|puisses tu crever|brûle en enfer
        muérete|muerete|ojalá te mueras|ojala te mueras|te mueras|mátate|matate|suicídate|púdrete|ahórcate|púdrete en el infierno"""),
    "harm": ("", 0.0, """kill|murder|strangle|stab|shoot|hurt|beat|choke|gut|skin|bury|hang|drown|burn|break|smash|crush|slit|cut|punch|kick|knock|destroy|rape|slap|bleed|torture|hunt down|find
        töten|umbringen|töte|brechen|breche|schlagen|schlage|verprügeln|abstechen|erwürgen|tuer|crever|casser|frapper|étrangler|égorger|éclater|péter|buter|matar|matarte|romper|romperte|golpear|pegar|rajar|partir|estrangular|tuerai|buterai|casserai|mataré|romperé"""),
    "body": ("", 0.0, "legs|leg|teeth|face|neck|throat|skull|bones|head|fingers|kneecaps|knees|jaw|nose|ribs|arms|guts|eyes|family|kids|house|beine|zähne|gesicht|hals|kehle|schädel|knochen|fresse|rippen|jambes|dents|gueule|cou|gorge|crâne|os|doigts|piernas|dientes|cara|cuello|garganta|huesos|dedos|cabeza"),
    "menace": ("abuse", 3.2, "find out where you live|know where you live|knows where you live|find you and|make you bleed|make you suffer|make you pay|make you regret|beat you up|beat you to|beat the shit out of you|beat the crap out of you|kick your ass|watch your back|you are dead|you re dead|youre dead|dead meat|you will regret this|come for you|coming for you|say that to my face|put a bullet|bullet in your|end you|ich finde dich|weiß wo du wohnst|mach dich fertig|mache dich fertig|mach dich kalt|bring dich um|bringe dich um|werde dich umbringen|je vais te tuer|je vais te crever|je sais où tu habites|te casser la gueule|sé dónde vives|te voy a matar|te voy a romper|te vas a arrepentir|beaten with a|gassed|lynched"),
    # groups of people and what is said to demean them
    "group": ("", 0.0, """women|woman|girls|females|men|foreigners|foreigner|immigrants|immigrant|migrants|refugees|refugee|asylum seekers|jews|jew|muslims|muslim|christians|hindus|sikhs|blacks|black people|white people|whites|asians|africans|arabs|mexicans|chinese|indians|pakistanis|turks|poles|russians|gypsies|roma|gays|gay people|gay|lesbians|homosexuals|queers|trans people|transsexuals|disabled|disabled people|cripples|autistic|autists|old people|elderly|pensioners|the poor|homeless|their race|whole race|this race|that race|their kind|your kind|your people|his kind|her kind|those people|these people|that sort of people|one of those|one of them|that faith|that religion|believers|their religion|skin colour|skin color|your race
        frauen|frau|mädchen|ausländer*|einwanderer|migranten|flüchtlinge*|asylanten|juden|jude|muslime|moslems|schwarze|schwarzen|türken|polen|zigeuner|schwule|schwulen|lesben|homosexuelle*|behinderte*|alte leute|alte menschen|rentner|asiaten|araber
        femmes|femme|filles|étrangers|étranger|immigrés|immigré|migrants|réfugiés|juifs|juif|musulmans|arabes|noirs|asiatiques|gays|homosexuels|lesbiennes|handicapés|les vieux|vieux|gitans|roms
        mujeres|mujer|chicas|extranjeros|extranjero|inmigrantes|inmigrante|refugiados|judíos|judío|musulmanes|moros|árabes|negros|asiáticos|gays|homosexuales|lesbianas|discapacitados|los viejos|viejos|ancianos|gitanos"""),
    "debase": ("", 0.0, """inferior|subhuman|animals|vermin|parasites|a disease|a plague|a cancer|cancer of|scum|thieves|thief|liars|criminals|rapists|terrorists|savages|cockroaches|rats|filth|trash|should not vote|not be allowed to|cannot code|can t code|cant code|cannot drive|cannot think|can t think|too stupid|too dumb|too emotional|not smart enough|less intelligent|belong in the kitchen|belongs in the kitchen|belong in a zoo|belong in a cage|stay in the kitchen|back to the kitchen|do not belong|don t belong|no place in|have no place|never hire|do not hire|don t hire|never trust|not to be trusted|cannot be trusted|can t be trusted|never to be trusted|make me sick|makes me sick|disgust me|disgust us|be deported|deport|be exterminated|exterminated|be gassed|wiped|wiped out|eradicated|be eliminated|be locked up|be shot|be hanged|be killed|be sterilised|be sterilized|be banned from|kicked out|kick them out|thrown out|throw them out|send them back|go home|go back to|back to where|back to your|not welcome|not wanted|nobody wants|slow us down|only good for|good for nothing|breed like|ruin everything|ruining our|taking over|stealing our|steal our|lazy|dirty|filthy|by blood|in their blood|is a sin|are sinners|unnatural|perverts|mentally ill|retarded|useless|worthless|stupid
        zu dumm|zu blöd|minderwertig*|ungeziefer|parasiten|tiere|untermenschen|schmarotzer|krank|abschaum|kriminelle|diebe|lügner|gehören raus|raus hier|raus aus|ausländer raus|juden raus|abschieben|abgeschoben|vergast|vergasen|an den herd|in die küche|gehören weg|gehören nicht|gehören eingesperrt|eingesperrt|ekelhaft|widerlich|nichts verloren|nichts zu suchen|faul|dreckig
        trop bêtes|trop bête|trop stupides|trop connes|inférieurs|inférieures|inférieure|vermine|parasites|des animaux|sous hommes|voleurs|menteurs|criminels|une maladie|malades|à la cuisine|dans la cuisine|dehors|expulser|expulsés|exterminer|me dégoûtent|nous dégoûtent|dégoûtants|rentrez chez|rentre chez|retourne dans|rentre dans|n ont rien à faire|n ont pas leur place|inutiles|sales|feignants|paresseux
        demasiado tontas|demasiado tontos|demasiado estúpidas|demasiado estúpidos|inferiores|inferior|plaga|una plaga|parásitos|animales|ladrones|mentirosos|criminales|delincuentes|enfermos|una enfermedad|a la cocina|en la cocina|fuera de aquí|fuera de este|deportar|expulsar|exterminar|me dan asco|nos dan asco|vuelve a tu|vuelvan a su|no tienen sitio|no pertenecen|inútiles|sucios|vagos|basura"""),
    "slur": ("hate", 3.2, """nigger*|nigga|niggas|faggot*|fag|fags|dyke|dykes|kike|kikes|tranny|trannies|shemale*|spic|spics|chink|chinks|gook|gooks|wetback*|towelhead*|raghead*|sandnigger*|paki|pakis|coon|coons|darkie*|jungle bunny|camel jockey|beaner*|zipperhead*|subhuman*|race traitor*|white power|white trash|heil hitler|sieg heil|inferior race*|master race|gas the jews|sand monkey|mongoloid
        untermensch*|kanake*|kanacke*|neger|judensau|scheißausländer|scheiss ausländer|schwuchtel*|zigeunerpack|ausländer raus|juden raus|rassenschande|dreckige ausländer
        bougnoul*|bicot|bicots|youpin*|négro*|sale arabe|sales arabes|sale juif|sales juifs|sale noir|sale race|tapette*|tarlouze*|pédale|gouine*|sous hommes|sous homme|sale étranger|sales étrangers|sale pédé
        sudaca*|maricón|maricones|marica|negrata*|moro de mierda|panchito*|judío de mierda|bollera*|infrahumano*|subhumano*|subhumana*|raza inferior|puto moro|tortillera"""),
    "exile": ("hate", 3.0, "back to your own country|back to your country|back to where you came|back where you came|nobody wants your people|nobody wants your kind|your kind is|your kind are|wiped from the earth|from the face of the earth|zurück in deine heimat|geh zurück wo du|zurück nach hause du|rentre dans ton pays|retourne dans ton pays|vuelve a tu país|vuelvete a tu pais|regresa a tu país"),
    # sexual
    "explicit": ("sexual", 2.8, """blowjob*|blow job*|handjob*|cumshot*|rimjob*|gangbang*|deepthroat*|masturbat*|jerk off|jerked off|jerking off|jack off|orgasm*|horny|pussy|tits|titties|boobs|cocks|my cock|your cock|his cock|my dick|your dick|his dick|dildo*|erection|erections|clit|cum on|cum in|cum inside|suck my|sucked my|lick my|lick your|licked her|fuck me|fucked me|fuck her|fucked her|fuck him|want to fuck|hard fuck|anal sex|oral sex|have sex|had sex|having sex|sex with|sleep with me|sleep with you|spread your legs|spreads her legs|spread her legs|between her legs|between your legs|send nudes|send me nudes|nudes of|nude pictures|nude picture|nude photos|nude pics|naked pictures|naked photos|naked pics|naked woman|naked women|naked girl|naked girls|naked man|naked body|naked ass|get naked|strip for me|undress for|moaned my|moans my|moaned as|moaning as|bend you over|bent her over|bend over for|make love to|in my bed|into my bed|sexy body|porn video*|porno*|hardcore porn|hentai|milf|threesome|wet panties|your panties|her panties|take off your clothes|take your clothes off|took off her|rip your clothes|tear your clothes|touch yourself|touch you under|touch me there|touch your body|whip you naked|your naked|her naked|his naked
        ficken|gefickt|fick mich|mit dir schlafen|mit mir schlafen|zieh dich aus|ausziehen für mich|nacktbilder|nacktfotos|nackt bilder|deine titten|titten|möpse|geil auf|macht mich geil|bin geil|blas mir|schwanz lutschen|in mein bett|muschi|wichsen|dich nackt|deine brüste
        coucher avec toi|coucher avec moi|envie de toi nue|photos de toi nue|toi nue|toi nu|te baiser|baise moi|baiser avec|déshabille toi|tes seins|tes nichons|tes fesses|sucer ma|suce ma|suce moi|ma bite|ta bite|ta chatte|bander pour|dans mon lit|faire l amour|te branler|branle
        acostarme contigo|acostarte conmigo|quítate la ropa|quitate la ropa|fotos tuyas desnuda|tuyas desnuda|fotos desnuda|desnúdate|tus tetas|tetas|tu culo|tus pechos|follarte|follar|chúpame|chupame|mi polla|tu coño|en mi cama|hacer el amor|correrme|cachonda|cachondo"""),
    "carnal": ("", 0.0, "naked|nude|sex|sexy|butt|breasts|breast|thighs|thigh|lips|mouth|panties|bra|underwear|lingerie|nipples|tight dress|something short|short skirt|skirt|undress|strip|bed|tonight|moan|kiss|lick|suck|touch|touch you|touch me|want you|around me|ride me|on top of me|nackt|brüste|hintern|küssen|bett|heute nacht|nue|seins|fesses|ce soir|lit|lèvres|desnuda|desnudo|pechos|culo|esta noche|cama|labios"),
    # What clears the words right after it, where they are only named; and what is no speech about people at all.
    "named": ("named", 0.0, "the word|the words|the term|the terms|word list*|words like|words such as|list of words|list of terms|blocked words|banned words|bad words|stop words|forbidden words|swear words|slurs such as|slurs like|insults such as|insults like|block list*|blocklist*|blacklist*|denylist*|deny list*|profanity filter*|filter matches|filter catches|filter rejects|filter removes|filter flags|similar terms|such terms|example of an insult|liste de mots|les mots|le mot|wortliste*|das wort|die wörter|la palabra|las palabras|lista de palabras"),
    "exempt": ("exempt", 0.0, "kill child|kill the process|kill process|kill the parent|kill the job|kill the server|kill a process|kill signal|killed by|child process*|master slave|slave node*|master and slave|dead code|dead letter*|dead lock|penetration test*|naked pointer*|naked return*|naked type*|naked domain*|breast cancer|breast screening|sex chromosome*|same sex|sex ratio|sex education|report abuse|abuse report*|abuse of|garbage collect*|garbage in|trash folder|trash bin|trash can|watch dog*|dog food*|dogfood*|rat race|monkey patch*|monkey test*|chaos monkey|lazy load*|lazy evaluat*|lazy init*|lazy val*|dirty flag|dirty page*|dirty read*|dirty bit|dirty tree|fat jar*|fat client*|fat pointer*|fat arrow|fat binary|total of|in total|ugly hack|you fool the|to fool|stupid mistake|code reviewer|god object|orphan process*|zombie process*|idiot proof|idiotproof|foolproof|kiss principle|failure of|failure in|on failure|animals table|head of|face of|neck of|foreign key*|canadian goose|scunthorpe"),
}
# Finds that lie beside one another: (first, then, most words between, weight, kind). Words between are only counted, but for ``=``:
# there all of them have to be among ``_LINKS``. Such a pair is a phrase with a gap.
_RULES = (
    ("slight", "name", 1, 2.4, "abuse"), ("slight", "vulgar", 1, 1.0, "abuse"), ("you", "name", "=", 2.2, "abuse"), ("you", "slight", "=", 2.4, "abuse"), ("name", "like", 0, 1.9, "abuse"), ("hush", "you", 2, 1.4, "abuse"), ("hush", "slight", 3, 1.4, "abuse"), ("hush", "name", 4, 1.4, "abuse"), ("them", "name", "=", 1.6, "abuse"),
    ("name", "you", 1, 1.4, "abuse"), ("will", "harm you", 3, 3.2, "abuse"), ("harm", "your body", 0, 3.2, "abuse"), ("harm", "body you", 3, 3.0, "abuse"),
    ("group", "debase", 9, 3.0, "hate"), ("debase", "group", 4, 2.8, "hate"), ("slight", "group", 1, 2.6, "hate"), ("group", "slight", 5, 2.4, "hate"), ("group", "name", 5, 2.4, "hate"), ("group", "vulgar", 5, 2.0, "hate"), ("group", "death", 9, 2.0, "hate"), ("group", "menace", 6, 2.0, "hate"),
    ("carnal", "your carnal", 6, 2.6, "sexual"), ("your carnal", "carnal", 6, 2.6, "sexual"), ("explicit", "carnal", 6, 1.0, "sexual"), ("carnal", "explicit", 6, 1.0, "sexual"),
)
_LINKS = frozenset("are re r is s was were a an the such so really just all very too nothing but bunch of most more little old absolute complete utter total people guys lot leute bist seid ein eine einen so ganz echt nur wirklich doch es est etes un une des vraiment trop tres si que eres son un una unos muy tan realmente and et und y".replace("l", "i").split())
_OWN = frozenset("your yours ur dein deine deinen deinem deiner euer ton ta tes votre vos tus".split())
THRESHOLD = 1.0  # a passage of that score is reported
_FULL = 32  # words from which on a passage is no longer thinned by its length
# Fixed look-alikes of Latin letters in other scripts.
_LOOKS = dict(zip("аеорсухіјѕԁһӏвкмнтгпԛԝαβγεζηικνορτυχωϲøłđßæœıŀ", ["a", "e", "o", "p", "c", "y", "x", "i", "j", "s", "d", "h", "l", "b", "k", "m", "h", "t", "r", "n", "q", "w", "a", "b", "y", "e", "z", "n", "i", "k", "v", "o", "p", "t", "u", "x", "w", "c", "o", "l", "d", "ss", "ae", "oe", "i", "l"], strict=True))
# Fixed substitutions of letters by figures and signs within a word.
_FIGURES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "+": "t", "!": "i", "|": "i", "€": "e"})
_ZERO_WIDTH = dict.fromkeys(map(ord, "​‌‍⁠﻿­᠎"), None)
_SPREAD = re.compile(r"(?<![^\W_])([^\W_](?:([ .\-_*·])[^\W_])(?:\2[^\W_])+)(?![^\W_])(?![.\-_*·]+[^\W_])")
_ODD = re.compile(r"(?<![\w@$+!|€*])(?=[a-z0-9@$+!|€*]*[a-z])(?=[a-z@$+!|€*]*[0-9@$+|€*]|[a-z]*![a-z])[a-z0-9@$+!|€*]+|(?<![\w@$+!|€*])(?=[0-9]*[@$+|€])[0-9@$+!|€]{4,}(?![\w@$+!|€*])")
_BREAK = "\x1e"
_GAPS = re.compile(rf"(?:[^\w{_BREAK}]|(?<![^\W_])_|_(?![^\W_]))+")  # an identifier stays one word
_RUNS = re.compile(r"([^\d\s])\1\1+")
_MIXED = re.compile(r"(?=.*[a-z])(?=.*[0-9@$+!|€])")
_USER = re.compile(r"^@?[a-z]{3,}\d{1,3}$")
# A passage ends with a sentence, a blank line, or before the next entry of a list or a chat; other line breaks are blanks.
_PASSAGE = re.compile(r"(?<=[.!?])[\"')\]»”]*\s+|\n\s*\n\s*|\n\s*(?=[-*+>#|•]|\d+[.)]\s|@?\w+:\s)")


def _plain(text: str) -> str:
    """Lower case without zero-width characters, accents and look-alikes."""
    t = text.translate(_ZERO_WIDTH).lower()
    if not t.isascii():
        t = "".join(_LOOKS.get(c, c) for c in t)
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        t = "".join(_LOOKS.get(c, c) for c in t)
    return t


def _canonical(words: str) -> str:
    """Letters that figures leave open are one, and a letter that stands three times or more stands once."""
    return _RUNS.sub(r"\1", words.replace("l", "i"))


@cache
def _automaton():
    """Aho-Corasick automaton over the lexicon's phrases in canonical spelling, and the plain words by length and first letter."""
    import ahocorasick

    values: dict[str, dict[str, tuple[str, float]]] = {}
    spelled: dict[tuple[int, str], set[str]] = {}
    for category, (kind, weight, text) in _LEXICON.items():
        for phrase in re.split(r"[|\n]", text):
            p = phrase.strip()
            if not p:
                continue
            open_end = p.endswith("*")
            words = re.split(r"[\s-]+", _plain(p.rstrip("*")))
            for w in words:
                if len(w) > 2 and weight:
                    spelled.setdefault((len(w), w[0]), set()).add(w)
            canon = _canonical(" ".join(words))
            once = re.sub(r"([a-z])\1", r"\1", canon)  # stretched letters fall together, so words of double ones have a second spelling
            for spelling in {canon, once if len(once) > 4 else canon}:
                values.setdefault(f" {spelling}" if open_end else f" {spelling} ", {})[category] = (kind, weight)
    auto = ahocorasick.Automaton()
    for key, v in values.items():
        auto.add_word(key, (len(key), key.endswith(" "), tuple((c, k, w) for c, (k, w) in v.items())))
    auto.make_automaton()
    return auto, spelled


def _masked(token: str, spelled: dict[tuple[int, str], set[str]]) -> str:
    """A word with stars for letters, spelled out if a word of the lexicon fits it."""
    m = re.fullmatch(r"([a-z]+)\*+([a-z]*)", token)
    if not m:
        return token
    fits = sorted(w for w in spelled.get((len(token), token[0]), ()) if w.startswith(m[1]) and w.endswith(m[2]))
    if not fits and m[2].endswith("s"):
        fits = sorted(w for w in spelled.get((len(token) - 1, token[0]), ()) if w.startswith(m[1]) and w.endswith(m[2][:-1]))
    return fits[0] if fits else token


def fold(text: str) -> str:
    """Canonical words of a text between single blanks; the passages between marks."""
    t = _plain(_PASSAGE.sub(f" {_BREAK} ", text))
    if _SPREAD.search(t):
        t = _SPREAD.sub(_joined, t)
    if _ODD.search(t):
        t = _ODD.sub(_straight, t)
    return f" {_BREAK} " + _RUNS.sub(r"\1", _GAPS.sub(" ", t).replace("l", "i")).strip() + f" {_BREAK} "


def _joined(m: re.Match[str]) -> str:
    """Letters that stand apart as one word; a first ``a`` or ``i`` is a word of its own if the rest is one of the lexicon."""
    w = re.sub(r"[ .\-_*·]", "", m[0])
    rest = w[1:].translate(_FIGURES)
    return f"{w[0]} {rest}" if w[0] in "ai" and len(w) > 3 and rest in _automaton()[1].get((len(rest), rest[0]), ()) else w


def _straight(m: re.Match[str]) -> str:
    w = m[0]
    if "*" in w:
        inner = w.strip("*")
        w = inner if inner.isalpha() else _masked(w, _automaton()[1])
    if (_MIXED.match(w) or not w.isalnum()) and "*" not in w and not _USER.match(w):
        w = (w.rstrip("!|") or w).translate(_FIGURES)
    return w


def _evidence(hits: list[tuple[int, int, str, str, float]], words: list[str]) -> dict[str, float]:
    """Weight of each kind that the finds of one passage add up to.

    ``hits``: first word, word after the last, category, kind, weight. What
    only names words is cleared: a naming phrase covers single words that
    follow within eight words of it, or of one another, unless they are said
    to somebody. Exempt phrases cover what they overlap.
    """
    exempt = [(a, b) for a, b, c, *_ in hits if c == "exempt"]
    live = sorted((h for h in hits if h[2] not in ("exempt", "named") and not any(h[0] < d and c < h[1] for c, d in exempt)), key=lambda h: (h[0], -h[1]))
    named = sorted(b for _, b, c, *_ in hits if c == "named")
    at: dict[str, list[tuple[int, int]]] = {}
    for a, b, c, *_ in live:
        at.setdefault(c, []).append((a, b))
    for first, then in (("your carnal", "carnal"), ("harm you", "harm"), ("your body", "body"), ("body you", "body")):
        # an address right beside the word: "your legs", "kill you", "te romper las piernas"
        near = 3 if first == "body you" else 0
        at[first] = [(a, b) for a, b in at.get(then, ()) if any((0 <= a - y <= near if first != "harm you" else words[x] not in _OWN and (0 <= x - b <= 1 or a == y)) for x, y in at.get("you", ()))]
    covered: set[tuple[int, int]] = set()
    if named:
        ends = list(named)
        for a, b, c, *_ in live:
            said = any(0 <= a - y <= 1 for _, y in at.get("you", ())) or c in ("death", "menace", "scorn")
            if b - a <= 3 and not said and c not in ("you", "them", "will", "like") and any(0 <= a - e <= 8 for e in ends):
                covered.add((a, b))
                ends.append(b)
    sums = {"abuse": 0.0, "hate": 0.0, "sexual": 0.0}
    taken: set[tuple[int, str]] = set()
    for a, b, _, kind, weight in sorted(live, key=lambda h: -h[4]):
        if weight and (a, b) not in covered and not any((i, kind) in taken for i in range(a, b)):
            sums[kind] += weight
            taken.update((i, kind) for i in range(a, b))
    for first, then, gap, weight, kind in _RULES:
        best = False
        for a, b in at.get(first, ()):
            for x, y in at.get(then, ()):
                if x >= b and (a, b) not in covered and (x, y) not in covered and (x - b <= 6 and all(w in _LINKS for w in words[b:x]) if gap == "=" else x - b <= gap):
                    best = True
        if best:
            sums[kind] += weight
    return sums


_CORE = frozenset(c for c, (k, w, _) in _LEXICON.items() if w) | {"group", "harm", "carnal"}


def score(text: str | None) -> tuple[float, float, float, float, float]:
    """(score, abuse, hate, sexual, share of passages) of a text; zeros for null and empty texts.

    The finds of the automaton in a passage and the rules on neighbouring
    finds add up to a weight; divided by 1 + log2(1 + words / 16), where words
    beyond ``_FULL`` no longer count, it is the passage's score, since the same
    words say less within much other talk. A text has the score of its worst passage, and
    the share of its passages that reach ``THRESHOLD``. Strong words reach it
    in a passage of any length, milder ones only in a short one or together.
    """
    if not text or text.isspace():
        return 0.0, 0.0, 0.0, 0.0, 0.0
    auto, _ = _automaton()
    f = fold(text)
    found: list[tuple[int, int, tuple]] = []
    core = False
    for end, (n, closed, values) in auto.iter(f):
        found.append((end - n + 2, end if closed else end + 1, values))
        core = core or any(c in _CORE for c, _, _ in values)
    if not core:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    most, reached, passages = {"abuse": 0.0, "hate": 0.0, "sexual": 0.0}, 0, f.count(_BREAK) - 1
    top, i, start = 0.0, 0, 0
    while i < len(found):
        start = f.rfind(_BREAK, 0, found[i][0]) + 2
        stop = f.find(_BREAK, found[i][0])
        j = i
        while j < len(found) and found[j][0] < stop:
            j += 1
        group, i = found[i:j], j
        if not any(c in _CORE for *_, v in group for c, _, _ in v):
            continue
        words = f[start : stop - 1].split(" ")
        hits = []
        for a, b, values in group:
            w = f.count(" ", start, a)
            z = w + f.count(" ", a, b) + 1
            hits += [(w, z, c, k, x) for c, k, x in values]
        thin = 1.0 + math.log2(1.0 + min(len(words), _FULL) / 16.0)
        sums = {k: v / thin for k, v in _evidence(hits, words).items()}
        whole = sum(sums.values())
        top = max(top, whole)
        reached += whole >= THRESHOLD
        for k, v in sums.items():
            most[k] = max(most[k], v)
    return round(top, 6), *(round(most[k], 6) for k in ("abuse", "hate", "sexual")), round(reached / max(1, passages), 6)


def abuse_scores(documents: DataFrame) -> DataFrame:
    """Score of each document: doc_id, source, score, abuse, hate, sexual, share, flagged; null texts score zero.

    ``flagged``: the worst passage reaches ``THRESHOLD``. Sources are trimmed
    and lower-cased; repeated rows of one doc_id count once, the one of the
    highest score; further columns are ignored; an empty table gives none.
    """
    names = ("score", "abuse", "hate", "sexual", "share")

    def run(b: dict[str, list]) -> dict[str, list]:
        got = [score(t) for t in b["text"]]
        return {"doc_id": b["doc_id"], "source": b["source"]} | {k: [g[i] for g in got] for i, k in enumerate(names)}

    picked = documents.select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    found = rows(picked, run, "doc_id long, source string, score double, abuse double, hate double, sexual double, share double")
    once = found.groupBy("doc_id").agg(F.max(F.struct("score", "abuse", "hate", "sexual", "share", "source")).alias("r"))
    return once.select("doc_id", "r.source", *(f"r.{k}" for k in names), (F.col("r.score") >= THRESHOLD).alias("flagged"))


def abuse_rates(scores: DataFrame) -> DataFrame:
    """Documents, flagged documents, rate and mean score for each source; a null source is a group of its own."""
    return scores.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.round(F.avg(F.col("flagged").cast("double")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
