"""The labelled hosts that ``op9_url_filter`` is trained on: known sites, listed by hand from general knowledge.

Blocked are adult sites, gambling, advertising and tracking, and mail-order pharmacies; the others are
ordinary sites.  The table is small and hasn't been checked against a published block list.  No host of
the test pages is in it, and it isn't made from word lists.  SPAM are names typical of mail-order spam
that aren't known to exist: real ones are short-lived.
"""

BAD = """
pornhub.com xvideos.com xnxx.com xhamster.com redtube.com youporn.com tube8.com spankbang.com beeg.com chaturbate.com
livejasmin.com stripchat.com bongacams.com cam4.com myfreecams.com brazzers.com bangbros.com adultfriendfinder.com
adulttime.com onlyfans.com fansly.com playboy.com hustler.com penthouse.com eporner.com porn.com pornhd.com
porntube.com sex.com adultempire.com literotica.com nhentai.net rule34.xxx e-hentai.org motherless.com drtuber.com
txxx.com hclips.com upornia.com thumbzilla.com pornpics.com sunporno.com tnaflix.com empflix.com keezmovies.com
extremetube.com pornone.com porntrex.com nuvid.com 4tube.com camsoda.com flirt4free.com xtube.com
bet365.com betfair.com betway.com bwin.com pokerstars.com partypoker.com 888casino.com 888poker.com leovegas.com
casumo.com mrgreen.com unibet.com williamhill.com ladbrokes.com paddypower.com draftkings.com fanduel.com betmgm.com
1xbet.com 22bet.com stake.com roobet.com bovada.lv betonline.ag ignitioncasino.eu slotomania.com casino.com
casinoroom.com pinnacle.com betsson.com betvictor.com tipico.de interwetten.com winamax.fr caesarscasino.com
goldennuggetcasino.com jackpotcitycasino.com spinpalace.com royalvegascasino.com betrivers.com vegasslotsonline.com
partycasino.com europacasino.com cherrycasino.com bet-at-home.com betano.com dafabet.com fun88.com 188bet.com
sbobet.com sportsbet.io bitcasino.io cloudbet.com mybookie.ag freebets.com freebets.co.uk
winbet.bg winner.com slots.lv slotsup.com freeslots.com onlinecasino.de
doubleclick.net googlesyndication.com googleadservices.com adservice.google.com ads.yahoo.com adnxs.com adsrvr.org
adform.net adroll.com taboola.com outbrain.com criteo.com criteo.net pubmatic.com rubiconproject.com openx.net
casalemedia.com scorecardresearch.com quantserve.com moatads.com advertising.com adcolony.com admob.com applovin.com
popads.net popcash.net propellerads.com exoclick.com juicyads.com trafficjunky.com adcash.com adsterra.com
clickadu.com mgid.com revcontent.com zedo.com bidswitch.net smartadserver.com yieldmo.com adtechus.com
atdmt.com serving-sys.com 2mdn.net tribalfusion.com amazon-adsystem.com ads-twitter.com
clicktale.net statcounter.com krxd.net bluekai.com demdex.net everesttech.net trackcmp.net
adbrite.com adfox.ru adriver.ru an.yandex.ru
canadianpharmacyking.com canadapharmacy.com canadadrugs.com northwestpharmacy.com viagra.com cialis.com levitra.com
kwikmed.com accessrx.com goldpharma.com inhousepharmacy.vu alldaychemist.com reliablerxpharmacy.com medstorerx.com
buy-pharma.md unitedpharmacies.md 4nrx.md
""".split()

GOOD = """
wikipedia.org en.wikipedia.org wikimedia.org archive.org gutenberg.org python.org docs.python.org rust-lang.org
kernel.org debian.org ubuntu.com gnu.org apache.org spark.apache.org mozilla.org w3.org ietf.org gitlab.com
bitbucket.org sourceforge.net php.net slideshare.net behance.net researchgate.net battle.net speedtest.net
asp.net cplusplus.com postgresql.org mysql.com sqlite.org nginx.org docker.com kubernetes.io npmjs.com pypi.org
nytimes.com washingtonpost.com theguardian.com reuters.com apnews.com bloomberg.com economist.com ft.com wsj.com
cnn.com npr.org aljazeera.com lemonde.fr lefigaro.fr liberation.fr spiegel.de zeit.de faz.net sueddeutsche.de
tagesschau.de elpais.com elmundo.es repubblica.it corriere.it nzz.ch derstandard.at irishtimes.com thehindu.com
nature.com science.org sciencedirect.com springer.com wiley.com jstor.org arxiv.org plos.org cell.com thelancet.com
nih.gov cdc.gov nasa.gov noaa.gov usgs.gov loc.gov census.gov whitehouse.gov gov.uk nhs.uk europa.eu un.org who.int
worldbank.org imf.org oecd.org unesco.org redcross.org amnesty.org greenpeace.org wwf.org
mit.edu harvard.edu stanford.edu berkeley.edu princeton.edu yale.edu cornell.edu ox.ac.uk cam.ac.uk ethz.ch tum.de
sorbonne-universite.fr uni-heidelberg.de utoronto.ca anu.edu.au nus.edu.sg coursera.org edx.org khanacademy.org
amazon.com ebay.com etsy.com walmart.com target.com ikea.com bestbuy.com costco.com homedepot.com zalando.de otto.de
apple.com microsoft.com google.com ibm.com intel.com nvidia.com oracle.com sap.com siemens.com bosch.com samsung.com
sony.com toyota.com honda.com bmw.com volkswagen.de renault.fr ford.com tesla.com boeing.com airbus.com
lufthansa.com airfrance.fr britishairways.com delta.com booking.com airbnb.com tripadvisor.com lonelyplanet.com
expedia.com kayak.com bahn.de sncf.com nationalrail.co.uk openstreetmap.org weather.com accuweather.com
metoffice.gov.uk imdb.com rottentomatoes.com netflix.com spotify.com soundcloud.com bandcamp.com last.fm vimeo.com
youtube.com twitch.tv discogs.com goodreads.com allrecipes.com bbcgoodfood.com epicurious.com chefkoch.de marmiton.org
webmd.com mayoclinic.org healthline.com nationalgeographic.com smithsonianmag.com metmuseum.org moma.org louvre.fr
britishmuseum.org tate.org.uk reddit.com quora.com medium.com wordpress.org blogger.com tumblr.com linkedin.com
dropbox.com slack.com zoom.us salesforce.com adobe.com autodesk.com figma.com canva.com paypal.com visa.com
chess.com lichess.org espn.com fifa.com uefa.com olympics.com nba.com formula1.com strava.com garmin.com
merriam-webster.com britannica.com oxforddictionaries.com leo.org dict.cc duolingo.com theatlantic.com newyorker.com
adidas.com addgene.org winzip.com slate.com cheapflights.com essex.ac.uk
github.io stackexchange.com mathoverflow.net ycombinator.com techcrunch.com theverge.com wired.com arstechnica.com
engadget.com cnet.com zdnet.com pcmag.com tomshardware.com anandtech.com gizmodo.com mashable.com lifehacker.com
forbes.com fortune.com businessinsider.com cnbc.com marketwatch.com investopedia.com time.com newsweek.com usatoday.com
latimes.com chicagotribune.com bostonglobe.com sfchronicle.com politico.com thehill.com axios.com vox.com salon.com
independent.co.uk telegraph.co.uk thetimes.co.uk mirror.co.uk dailymail.co.uk standard.co.uk scotsman.com abc.net.au
smh.com.au theage.com.au nzherald.co.nz stuff.co.nz cbc.ca globeandmail.com thestar.com japantimes.co.jp scmp.com
straitstimes.com timesofindia.com indianexpress.com dawn.com haaretz.com dw.com france24.com rfi.fr swissinfo.ch
lego.com nike.com puma.com patagonia.com rei.com gap.com hm.com zara.com uniqlo.com levis.com macys.com nordstrom.com
sephora.com lowes.com staples.com wayfair.com newegg.com logitech.com dell.com hp.com lenovo.com asus.com acer.com
cisco.com vmware.com redhat.com suse.com digitalocean.com heroku.com cloudflare.com fastly.com akamai.com godaddy.com
audi.com porsche.com volvocars.com hyundai.com kia.com nissan.com mazda.com subaru.com peugeot.fr fiat.it
philips.com panasonic.com canon.com nikon.com lg.com ge.com honeywell.com caterpillar.com shell.com bp.com total.com
nestle.com unilever.com kelloggs.com starbucks.com mcdonalds.com subway.com dominos.com hellofresh.com opentable.com
yelp.com zillow.com realtor.com rightmove.co.uk hotels.com marriott.com hilton.com hyatt.com united.com southwest.com
klm.com emirates.com qantas.com fedex.com ups.com dhl.com usps.com royalmail.com verizon.com vodafone.com telekom.de
chase.com wellsfargo.com hsbc.com barclays.co.uk santander.com ubs.com fidelity.com vanguard.com mastercard.com
instagram.com facebook.com twitter.com pinterest.com snapchat.com whatsapp.com telegram.org signal.org discord.com
skype.com yahoo.com bing.com duckduckgo.com baidu.com yandex.ru ecosia.org wolframalpha.com mathworks.com desmos.com
jetbrains.com eclipse.org visualstudio.com tensorflow.org pytorch.org scikit-learn.org numpy.org pandas.pydata.org
kaggle.com huggingface.co r-project.org julialang.org golang.org lwn.net launchpad.net ripe.net arin.net apnic.net
livejournal.com deviantart.com codeproject.com drupal.org joomla.org gnome.org kde.org phys.org ruby-lang.org perl.org haskell.org scala-lang.org
""".split()

SPAM = """
buycheapviagra.com cheapviagraonline.com cheapmeds-rx.com discountpills.com buypillsonline.com edpillsrx.com
dietpills-shop.com genericpills.com cheap-cialis-pills.org pillstore-online.com cheapgenerics.com
""".split()
